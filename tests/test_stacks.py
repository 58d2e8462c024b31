"""Image stacks: the TIFF source, and all published measures in one pass against the relational operators."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.functions import numbers as X
from stratalith.operators import components as C
from stratalith.operators import grid as G
from stratalith.operators import stack_measures as K
from stratalith.plans import workflows as W
from stratalith.sources import stacks as T

VOXEL = 0.13 * 0.13 * 0.5


def lzw(data):
    """Packs as the format describes it: a new table at its 4094th entry, codes one bit wider as soon as entry 511, 1023 or 2047 is there."""
    held = bits = 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width

    table, following, width, now = {bytes([i]): i for i in range(256)}, 258, 9, b""
    put(256, width)
    for k in range(len(data)):
        longer = now + data[k : k + 1]
        if longer in table:
            now = longer
            continue
        put(table[now], width)
        table[longer] = following
        following += 1
        now = data[k : k + 1]
        if following == 4095:
            put(256, 12)
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif following in (512, 1024, 2048):
            width += 1
    if now:
        put(table[now], width)
        following += 1
        width += following in (512, 1024, 2048)
    put(257, width)
    pad = -bits % 8
    return (held << pad).to_bytes((bits + pad) // 8, "big")


PACK = {1: bytes, 5: lzw, 8: zlib.compress}


def tiff(layers, order="<", compression=1, predictor=1, dtype="u2", rows=None, big=False, tile=None, planar=1):
    """A TIFF file of layers (height x width, or height x width x samples)."""
    number, wide = ("Q", 8) if big else ("I", 4)
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)
    last = len(out) - wide
    for layer in layers:
        cells = np.asarray(layer, np.dtype(dtype))
        cells = cells[:, :, None] if cells.ndim == 2 else cells
        h, w, s = cells.shape
        if tile:
            blocks = [np.pad(cells[i : i + tile, j : j + tile], ((0, max(0, i + tile - h)), (0, max(0, j + tile - w)), (0, 0))) for i in range(0, h, tile) for j in range(0, w, tile)]
        else:
            step = rows or h
            planes = [cells] if planar == 1 else [cells[:, :, k : k + 1] for k in range(s)]
            blocks = [p[i : i + step] for p in planes for i in range(0, h, step)]
        places = []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(b.dtype)
            data = PACK[compression](b.astype(b.dtype.newbyteorder(order)).tobytes())
            places.append((len(out), len(data)))
            out += data
        kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
        offsets, counts = zip(*places)
        tags = {256: [w], 257: [h], 258: [8 * cells.dtype.itemsize] * s, 259: [compression], 277: [s], 284: [planar], 317: [predictor], 339: [kind]}
        tags |= {322: [tile], 323: [tile], 324: offsets, 325: counts} if tile else {273: offsets, 278: [rows or h], 279: counts}
        entries = b""
        for tag, values in sorted(tags.items()):
            body = struct.pack(f"{order}{len(values)}I", *values)
            if len(body) > wide:
                where = len(out)
                out += body
                body = struct.pack(order + number, where)
            entries += struct.pack(order + "HH" + number, tag, 4, len(values)) + body.ljust(wide, b"\0")
        struct.pack_into(order + number, out, last, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        last = len(out)
        out += struct.pack(order + number, 0)
    return bytes(out)


RNG = np.random.default_rng(4)
SMOOTH = (np.add.outer(np.arange(61), np.arange(53)) // 3 % 200).astype(np.uint16)


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "u4"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_compressed_files_equal_plain_ones(dtype, predictor):
    noise = RNG.integers(0, 120, (40, 37)).astype(dtype)
    layers = [noise, SMOOTH.astype(dtype), np.zeros((5, 3), dtype)]
    for order in "<>":
        for compression in PACK:
            for kind in ({}, {"rows": 7}, {"tile": 16}, {"big": True}):
                got = T.decode(tiff(layers, order, compression, predictor, dtype, **kind))
                assert len(got) == 3 and all((a == b).all() for a, b in zip(got, layers))


def test_long_lzw_data():
    """More than one table: codes of all widths, and a new table behind the 4094th entry."""
    for data in (RNG.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), b"ab" * 40_000, b"", b"x"):
        assert T._lzw(lzw(data)) == data
    for broken in (b"\x00\x00\x00", b"\x80\x7f\xc0"):
        with pytest.raises(ValueError):
            T._lzw(broken)


def test_samples_floats_and_refusals():
    rgb = RNG.integers(0, 255, (6, 5, 3)).astype("u1")
    for planar in (1, 2):
        assert (T.decode(tiff([rgb], dtype="u1", planar=planar, rows=4))[0] == np.median(rgb, axis=2)).all()
    floats = RNG.random((6, 5)).astype("f4")
    assert (T.decode(tiff([floats], ">", 8, dtype="f4"))[0] == floats).all()
    for bad in (b"no", b"II*\0", tiff([floats], dtype="f4", predictor=2), tiff([SMOOTH]).replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 7))):
        with pytest.raises((ValueError, struct.error)):
            T.decode(bad)


def test_one_stack_is_read_by_many_tasks(spark, tmp_path):
    layers = [np.full((4, 5), z) for z in range(1000)]
    (tmp_path / "a_b.tif").write_bytes(tiff(layers, compression=5))
    for k in range(5):
        (tmp_path / f"small{k}.TIFF").write_bytes(tiff(layers[:2]))
    (tmp_path / "note.txt").write_text("no image")
    found = T.read_stacks(spark, str(tmp_path), part_bytes=20_000)
    per_task = found.filter("sample_name = 'a--b'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) > 5 and max(r["count"] for r in per_task) < 2 * min(r["count"] for r in per_task)
    got = {(r["sample_name"], r["z"]): r for r in found.collect()}
    assert len(got) == 1010 and all(got["a--b", z]["pixels"] == [z] * 20 and got["a--b", z]["layers"] == 1000 for z in range(1000))
    assert found.select(F.spark_partition_id().alias("t")).filter("t >= 0").distinct().count() < 5 + len(per_task)  # small files share tasks
    whole = {(r["sample_name"], r["z"]): r for r in T.read_stack_files(spark, str(tmp_path)).collect() if r["sample_name"] == "a--b"}
    assert len(whole) == 1000 and all(whole[k] == got[k] for k in whole)
    (tmp_path / "none").mkdir()
    assert T.read_stacks(spark, str(tmp_path / "none")).count() == 0


def stacks():
    rng = np.random.default_rng(11)
    blobs = np.kron(rng.integers(0, 6, (5, 6, 5)), np.ones((1, 2, 3))) * 11
    return {"noise": rng.integers(0, 255, (6, 17, 12)), "blobs": blobs, "zeros": np.concatenate([rng.integers(1, 9, (2, 9, 9)), np.zeros((2, 9, 9))]), "one": rng.integers(0, 9, (1, 8, 8)), "flat": np.full((3, 8, 9), 7), "dark": np.zeros((2, 8, 8))}


def layers_of(spark, chosen, n_parts=1, known=True):
    rows = [(name, z, len(s), s.shape[1], s.shape[2], 1, s[z].astype(float).ravel().tolist()) for name, s in chosen.items() for z in range(len(s))]
    df = spark.createDataFrame(rows, T.LAYERS).repartitionByRange(n_parts, "sample_name", "z") if n_parts > 1 else spark.createDataFrame(rows, T.LAYERS).coalesce(1)
    return df if known else df.drop("layers")


@pytest.fixture(scope="module")
def measured(spark):
    return K.measure(layers_of(spark, stacks()), VOXEL).cache()


@pytest.fixture(scope="module")
def cells(spark):
    return T.pixel_rows(layers_of(spark, stacks())).cache()


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g is None) == (w is None) and (w is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9)), (k, g, w)


def test_layer_measures_equal_the_relational_operators(spark, measured, cells):
    found = K.layer_rows(measured, VOXEL)
    got = {(r["sample_name"], r["z"], r["feature"]): r["value"] for r in found.collect()}
    want = {}

    def put(rows, names):
        for r in rows.collect():
            for n, feature in names.items():
                want[r["sample_name"], r["z"], feature] = r[n]

    put(G.intensity(cells), {n: n for n in ("mean", "med", "max", "min", "diff", "std")})
    put(G.emptiness(cells), {"minProp": "minProp"})
    put(G.value_frequency(cells, VOXEL), {"GPTVolume": "GPTVolume"})
    same({k: v for k, v in got.items() if k in want}, want)
    side = {n: min(s.shape[1:]) for n, s in stacks().items()}
    for n in stacks():
        boxes = G.fractal_dimension(G.box_counts(cells.filter(F.col("sample_name") == n), G.box_sizes(side[n])))
        slopes = {r["z"]: r["GPTFractalDim"] for r in boxes.collect()}
        same({z: got[n, z, "GPTFractalDim"] for z in slopes}, {z: v if side[n] >= 8 else None for z, v in slopes.items()})
    counts = {}
    for centred, name in ((False, "counts(inten<"), (True, "counts(Norminten<")):
        for n, s in stacks().items():
            for z, image in enumerate(s.astype(float)):
                if centred:
                    image = C.centre(image)
                for t in X.THRESHOLDS:
                    counts[n, z, f"{name}{t}"] = 1 if image.max() == 0 else brute(image / image.max() > t)
    same({k: v for k, v in got.items() if k in counts}, counts)
    volumes = {}
    for t in X.THRESHOLDS:
        for n, s in stacks().items():
            for z in range(len(s)):
                volumes[n, z, f"BioVolumeThr{t}"] = sum(counts[n, k, f"counts(inten<{t}"] for k in range(len(s))) * VOXEL / 134**2
    same({k: v for k, v in got.items() if k in volumes}, volumes)
    own = found.filter("NOT endswith(feature, 'Normalized')")
    shares = {(r["sample_name"], r["z"], r["feature"] + "Normalized"): r["share"] for r in G.share_of_total(own).collect()}
    same({k: v for k, v in got.items() if k in shares}, shares)
    assert len({k[2] for k in got}) == 192


def brute(on):
    seen, n = set(), 0
    for start in zip(*np.nonzero(on)):
        n += start not in seen
        todo = [start]
        while todo:
            x, y = todo.pop()
            if (x, y) in seen or not (0 <= x < on.shape[0] and 0 <= y < on.shape[1]) or not on[x, y]:
                continue
            seen.add((x, y))
            todo += [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return n


def stack_wants(cells):
    want = {}
    for r in G.spreading(cells).collect():
        want |= {(r["sample_name"], f): r[c] for c, f in zip(("sxy", "sz", "sxyz"), K.SPREADS)}
    grey = G.normalised(cells).withColumn("v", F.coalesce(F.floor("v"), F.lit(0)))
    for r in G.cooccurrence(grey).groupBy("sample_name").agg(*[F.avg(c).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")]).collect():
        want |= {(r["sample_name"], f): r[f[3:].lower()] for f in K.TEXTURE}
    for r in G.thickness(G.normalised(cells)).collect():
        want |= {(r["sample_name"], K.HEIGHTS[r["i"]]): r["thickness"], (r["sample_name"], K.STEPS[r["i"]]): r["roughness"]}
    for r in G.transition_homogeneity(cells, 256).collect():
        want[r["sample_name"], "Homogenity"] = r["homogeneity"]
    for n, s in stacks().items():
        ground = s[0].astype(float)
        want[n, "SubstratumRelativeCoverage"] = 100 * (brute(ground / ground.max() > X.THRESHOLDS[2]) if ground.max() else 1) / ground.size
    return want


def test_stack_measures_equal_the_relational_operators(spark, measured, cells):
    want = stack_wants(cells)
    got = {(r["sample_name"], r["feature"]): r["value"] for r in K.stack_rows(measured).collect()}
    assert measured.filter("kind = 'run'").count() == 0
    same(got, want)


@pytest.mark.parametrize("parts,known,held", [(9, True, 1 << 20), (1, False, 1 << 20), (1, True, 100), (4, False, 0)])
def test_runs_of_layers_merge_to_the_same(spark, cells, parts, known, held):
    """However layers are dealt to tasks, whether their number is known, and whether a stack can be held."""
    layers = layers_of(spark, stacks(), parts, known)
    found = K.measure(layers, VOXEL, held).cache()
    assert found.filter("kind = 'run'").count() > 0
    got = {(r["sample_name"], r["feature"]): r["value"] for r in K.stack_rows(found, K.transitions(layers, K.open_stacks(found))).collect()}
    same(got, stack_wants(cells))
    found.unpersist()


def test_global_measures(measured):
    got = {(r["sample_name"], r["feature"]): r["value"] for r in K.global_rows(measured).collect()}
    want = {}
    for n, s in stacks().items():
        steps = np.diff(s.mean(axis=(1, 2)))
        if len(steps):
            want |= {(n, f): v for f, v in zip(K.GLOBAL, (s.mean(), steps.mean(), steps.max(), steps.min(), 1.0))}
    same(got, want)


def test_all_published_names_and_no_pixel_in_a_shuffle(spark, tmp_path):
    for n, s in stacks().items():
        if n != "one":
            (tmp_path / f"{n}_x.tif").write_bytes(tiff(s.astype(np.uint16), compression=5, predictor=2))
    found = W.generate_features(spark, str(tmp_path))
    rows = found.collect()
    names = {r["feature"] for r in rows}
    assert {r["sample_name"] for r in rows} == {f"{n}--x" for n in stacks() if n != "one"} and len(names) == 2660 and len(rows) == 2660 * 5
    assert "counts(inten<0.060000000000000005-SUMMARYCustomAlgos.tsv_q90.txt" in names and "mdiffs-SUMMARYDiffGlobal.tsv_mean.txt" in names
    got = {r["feature"]: r["value"] for r in rows if r["sample_name"] == "noise--x"}
    assert got["GPTContrast-SUMMARYCustomAlgos.tsv_std.txt"] == 0.0 and got["eigen-SUMMARYDiffGlobal.tsv_std.txt"] is None
    plan = K.measure(layers_of(spark, stacks()), VOXEL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    shared = W.generate_features(spark, str(tmp_path), part_bytes=300)
    same({(r["sample_name"], r["feature"]): r["value"] for r in shared.collect()}, {(r["sample_name"], r["feature"]): r["value"] for r in rows})


def test_voxels():
    assert X.voxel_dimensions("0.2", 1, 0.5) == (0.2, 1.0, 0.5)
    for bad in (0, -1, "x", None, float("nan"), "inf"):
        with pytest.raises(ValueError, match="along y"):
            X.voxel_dimensions(1, bad, 1)


def test_components_of_large_images_are_fast():
    import time

    image = RNG.random((512, 512))
    began = time.perf_counter()
    counts = C.components_above(image, X.THRESHOLDS)
    assert time.perf_counter() - began < 6 and counts[0] == 1
    on = RNG.random((60, 70)) < 0.3
    assert C.count_components(on) == brute(on)
