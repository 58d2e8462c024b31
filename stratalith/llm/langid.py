"""Language identification by compression: the language whose raw-content zstandard dictionary makes a text smallest.

Dictionaries are made of bounded samples of labelled rows: `sample_docs` documents a language, chosen by a hash of their
text, each giving the slice of `slice_chars` characters at a hashed place, `dict_bytes` in all (less if there are so many languages
that `total_bytes` would be passed). A text is reduced to lower-case letters and single spaces and cut into blocks of `block_bytes`; every block is compressed with every dictionary, so that a
long text doesn't become its own dictionary, and the sizes are added up over the whole text. The score grows from one half with the gap
between the two best languages; texts with a gap of less than `margin` of their bytes (ties, above all) are rejected.

Defined results: null text or text without a letter gives `und`, score 0 and is rejected; ties go to the language with more
training rows, then the smaller name; without training rows everything is `und`. Texts of any length are compressed at one level. Repeated rows are
predicted row by row, and count once for the dictionaries; other columns, whatever their names, are neither read nor changed; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_values

UNKNOWN = "und"
#: zstandard level of every text, short or long.
LEVEL = 6
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letters_of(text: str) -> bytes:
    """Lower-cased text with every run of ASCII characters that are no letters as one space: shouting and markup don't count."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def learn_dictionaries(training: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400, slice_chars: int = 1000, dict_bytes: int = 112 << 10, total_bytes: int = 32 << 20) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of training rows; counts come from all rows, dictionaries from a bounded sample."""
    rows = training.filter(F.col(lang_col).isNotNull())
    lettered = F.col(text_col).rlike(r"\p{L}")
    found_rows = rows.groupBy(lang_col).agg(F.count("*"), F.approx_count_distinct(F.when(lettered, F.xxhash64(text_col)), 0.02)).collect()
    counts, texts = {r[0]: r[1] for r in found_rows}, {r[0]: r[2] for r in found_rows}
    if not counts:
        return []
    size = max(1024, min(dict_bytes, total_bytes // len(counts)))
    # a share of each language by hash, of more than sample_docs different texts whatever the table's size and its copies
    share = F.create_map(*[x for lang, n in texts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * sample_docs / max(1, n))))])
    picked = rows.withColumn("_h", F.xxhash64(text_col)).filter(F.pmod("_h", F.lit(1_000_003)) < share[F.col(lang_col)] * 1_000_003)
    length = F.greatest(F.char_length(text_col) - slice_chars, F.lit(0)) + 1
    slices = picked.filter(lettered).select(F.col(lang_col).alias("lang"), "_h", F.substring(text_col, (F.pmod(F.col("_h"), length) + 1).cast("int"), F.lit(slice_chars)).alias("part")).distinct()
    pieces: dict[str, list[tuple[int, bytes]]] = {}
    for r in slices.collect():
        pieces.setdefault(r["lang"], []).append((r["_h"], letters_of(r["part"])))
    out = []
    for lang, found in sorted(pieces.items(), key=lambda x: (-counts[x[0]], x[0])):
        found.sort()
        raw = b"\n".join(p for _, p in found[:sample_docs])
        out.append((lang, raw[-size:]))
    return out


class Classifier:
    """Compressors of one worker: made anew from the dictionaries' bytes wherever it is unpickled."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], block_bytes: int = 4096, level: int = LEVEL):
        self.made = (dictionaries, block_bytes, level)
        self.block = block_bytes
        self.langs = [lang for lang, _ in dictionaries]
        self.tools = [self._compressor(raw, level) for _, raw in dictionaries]

    def __reduce__(self):
        return Classifier, self.made

    @staticmethod
    def _compressor(raw: bytes, level: int):
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(t.compress(b)) for b in blocks) for t in self.tools]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and margin between the two best languages as a share of the text's bytes."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        raw = letters_of(text)
        sizes = self.sizes(raw)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / len(raw)
        return self.langs[best], 0.5 + 0.5 * (second - sizes[best]) / max(1, second), margin


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text", margin: float = 0.0005) -> DataFrame:
    """One row per document: id_col, lang_pred, score (0 to 1), margin, accepted. Only id and text are read; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(Classifier(dictionaries))

    def fn(batch):
        found = [held.value.predict(t) for t in text_values(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[0] != UNKNOWN and x[2] >= margin for x in found], pa.bool_())], names=[id_col, "lang_pred", "score", "margin", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], fn, f"`{id_col}` {kind}, lang_pred string, score double, margin double, accepted boolean")


def keep_identified(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text", margin: float = 0.0005) -> DataFrame:
    """Rows of `docs`, unchanged, whose text's language is found with at least `margin`."""
    held = docs.sparkSession.sparkContext.broadcast(Classifier(dictionaries))
    at = docs.columns.index(text_col)

    def fn(batch):
        found = [held.value.predict(t) for t in text_values(batch.column(at))]
        yield batch.filter(pa.array([x[0] != UNKNOWN and x[2] >= margin for x in found], pa.bool_()))

    return map_batches(docs, docs.columns, fn, docs.schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that are not held out: crc32 of the id as text, modulo 4, is not 2 (a null id is never held out)."""
    return docs.filter(~F.coalesce(held_out(id_col), F.lit(False)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
