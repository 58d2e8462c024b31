"""TIFF stacks as DataFrames: one row per layer, decoded where the file is read.

Both byte orders, classic and big (64-bit) TIFF, any number of pages, strips or tiles, uncompressed, PackBits, deflate or LZW, with or without the
horizontal predictor, 8, 16 or 32 bits of unsigned or signed integers or 32/64-bit floats, one or more samples a pixel (several, whether side by side or in
planes, are reduced to their median). Other files raise an error.

`read_stacks` is a Python data source whose partitions are shares of a file's pages: the driver lists files only, a task walks the
chain of page directories (a few bytes a page) and reads and decodes the strips of its own pages. `read_stack_files` takes whole files through
Spark's own reader instead, for stores that only Spark opens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

# fixed values: sizes and formats of TIFF field types, and the tags read
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339

LAYERS = "sample_name string, z long, layers long, height long, width long, samples long, pixels array<double>"

Read = Callable[[int, int], bytes]


def _packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 starts a new table, 257 ends, and the width grows one code before the table is full."""
    out = bytearray()
    table: list[bytes] = []
    held = bits = 0
    width, last = 9, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table:
            raise ValueError("LZW data that doesn't begin with an empty table")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 32773: _packbits, 8: zlib.decompress, 32946: zlib.decompress}


def directories(read: Read) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of every page, in order; only the directories are read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else None
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    number, size, entry, room = ("Q", 8, 20, 8) if big else ("I", 4, 12, 4)
    at, seen = struct.unpack_from(order + number, head, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        lead = 8 if big else 2
        n = struct.unpack(order + ("Q" if big else "H"), read(at, lead))[0]
        block = read(at + lead, n * entry + size)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", block, entry * k)
            count = struct.unpack_from(order + number, block, entry * k + 4)[0]
            if kind in _FORMATS:
                place, length = entry * k + 4 + size, _SIZES[kind] * count
                value = block[place : place + length] if length <= room else read(struct.unpack_from(order + number, block, place)[0], length)
                tags[tag] = struct.unpack(f"{order}{count}{_FORMATS[kind]}", value)
        yield order, tags
        at = struct.unpack_from(order + number, block, n * entry)[0]


def page(read: Read, order: str, tags: dict[int, tuple]) -> np.ndarray:
    """One page as height x width x samples."""
    height, width, samples = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(tags.get(FORMAT, (1,))[0])
    bits = set(tags.get(BITS, (1,)))
    unpack, predictor = _UNPACK.get(tags.get(COMPRESSION, (1,))[0]), tags.get(PREDICTOR, (1,))[0]
    if unpack is None or kind is None or len(bits) != 1 or bits - {8, 16, 32, 64} or predictor not in (1, 2) or (predictor == 2 and kind == "f"):
        raise ValueError(f"this TIFF page isn't read: compression {tags.get(COMPRESSION)}, predictor {predictor}, bits {sorted(bits)}, format {tags.get(FORMAT)}")
    dtype = np.dtype(f"{order}{kind}{bits.pop() // 8}")
    planes = samples if tags.get(PLANAR, (1,))[0] == 2 else 1
    each = samples // planes
    tiled = TILE_OFFSETS in tags
    if tiled:
        block_h, block_w = tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        block_h, block_w = min(tags.get(ROWS, (height,))[0], height), width
        offsets, counts = tags[OFFSETS], tags[COUNTS]
    down, across = -(-height // block_h), -(-width // block_w)
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, (i, j) = k // (down * across), divmod(k % (down * across), across)
        top, left = i * block_h, j * block_w
        rows = block_h if tiled else min(block_h, height - top)
        cells = np.frombuffer(unpack(read(offset, count)), dtype, rows * block_w * each).reshape(rows, block_w, each).astype(dtype.newbyteorder("="))
        if predictor == 2:
            cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
        h, w = min(rows, height - top), min(block_w, width - left)
        out[top : top + h, left : left + w, plane * each : plane * each + each] = cells[:h, :w]
    return out


def _flat(cells: np.ndarray) -> np.ndarray:
    return cells[:, :, 0].astype(np.float64) if cells.shape[2] == 1 else np.median(cells.astype(np.float64), axis=2)


def decode(raw: bytes) -> list[np.ndarray]:
    """Layers of a TIFF file as 2-D arrays."""
    read = lambda offset, n: raw[offset : offset + n]
    return [_flat(page(read, order, tags)) for order, tags in directories(read)]


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("_", "--")


def _rows(name: str, read: Read, share: int = 0, shares: int = 1) -> Iterator[pa.RecordBatch]:
    """One batch a layer: of `shares` equal runs of a file's pages, the run number `share`."""
    found = list(directories(read))
    n = len(found)
    for z in range(n * share // shares, n * (share + 1) // shares):
        cells = page(read, *found[z])
        layer = _flat(cells)
        numbers = {"z": z, "layers": n, "height": layer.shape[0], "width": layer.shape[1], "samples": cells.shape[2]}
        yield pa.RecordBatch.from_arrays([pa.array([_stem(name)]), *[pa.array([v], pa.int64()) for v in numbers.values()], pa.array([layer.ravel()], pa.list_(pa.float64()))], names=["sample_name", *numbers, "pixels"])


@dataclass
class Share(InputPartition):
    """Files, each with the share of its pages that is read: (path, share, shares)."""

    parts: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part_bytes = options["path"], int(options.get("partBytes", 64 << 20))

    def partitions(self):
        from pyarrow import fs

        system, root = _opened(self.path)
        infos = [system.get_file_info(root)]
        if infos[0].type == fs.FileType.Directory:
            infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        elif infos[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out: list[Share] = []
        room = 0
        for info in sorted((i for i in infos if i.is_file and i.base_name.lower().rsplit(".", 1)[-1] in ("tif", "tiff") and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            shares = max(1, -(-info.size // self.part_bytes))
            if shares > 1:
                out += [Share([(info.path, k, shares)]) for k in range(shares)]
                room = 0
            elif room >= info.size:  # small files share a task
                out[-1].parts.append((info.path, 0, 1))
                room -= info.size
            else:
                out.append(Share([(info.path, 0, 1)]))
                room = self.part_bytes - info.size
        return out or [Share([])]

    def read(self, partition):
        system, _ = _opened(self.path)
        for path, share, shares in partition.parts:
            with system.open_input_file(path) as f:
                yield from _rows(path, lambda offset, n, f=f: f.read_at(n, offset), share, shares)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TiffStacks(DataSource):
    """`spark.read.format("tiff_stacks").option("partBytes", n).load(path)`: layers of all .tif and .tiff files at or below a path."""

    @classmethod
    def name(cls):
        return "tiff_stacks"

    def schema(self):
        return LAYERS

    def reader(self, schema):
        return _Reader(self.options)


def read_stacks(spark: SparkSession, path: str, part_bytes: int = 64 << 20) -> DataFrame:
    """(sample_name, z, layers, height, width, samples, pixels array<double>), one row per layer; a file of more than `part_bytes` is read by several tasks."""
    ship(spark)
    spark.dataSource.register(TiffStacks)
    return spark.read.format("tiff_stacks").option("partBytes", str(part_bytes)).load(path)


def read_stack_files(spark: SparkSession, path: str) -> DataFrame:
    """As `read_stacks`, from any store Spark opens; a file is decoded in one task, its layers leave one by one."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                yield from _rows(name, lambda offset, n, raw=raw: raw[offset : offset + n])

    return files.mapInArrow(run, LAYERS)


def pixel_rows(layers: DataFrame) -> DataFrame:
    """Layers as pixels (sample_name, z, x, y, v); x counts rows, y columns."""
    cells = layers.select("sample_name", "z", "width", F.posexplode("pixels").alias("i", "v"))
    return cells.select("sample_name", "z", F.floor(F.col("i") / F.col("width")).alias("x"), (F.col("i") % F.col("width")).alias("y"), "v")


def layer_rows(pixels: DataFrame) -> DataFrame:
    """The other way: pixels (sample_name, z, x, y, v), each place once, as one row a layer. For tables that come as pixels; a source of layers needs no such shuffle."""
    grouped = pixels.groupBy("sample_name", "z").agg((F.max("x") + 1).alias("height"), (F.max("y") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("x", "y", F.col("v").cast("double").alias("v")))).alias("cells"))
    whole = F.when(F.size("cells") == F.col("height") * F.col("width"), F.transform("cells", lambda c: c["v"])).otherwise(F.raise_error(F.lit("a layer has places with no or several pixels")))
    return grouped.select("sample_name", "z", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), whole.alias("pixels"))
