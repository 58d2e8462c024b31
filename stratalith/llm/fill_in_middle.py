"""Fill-in-middle transformation by escaped marker injection, in SQL functions only.

A text is a run of units (by default lines with their line feed). A delimiter, escaped in the text beforehand, is put behind every unit by one
regular expression; counting it counts the units, and `substring_index` takes the first, the middle and the last units by their rank. So no
unit becomes a row or an array element, and a text of any length is worked on in one pass within one row, without a shuffle.

Where to cut and which form to take follow from SHA-256 of `seed:id`, so the result is the same in any order, in any partitioning and after a
lost executor.

Defined results: a null text is the empty text; an empty text, and one that holds a marker itself, stays as it is (form `plain`, no parts, no
cuts); a null id is hashed as the empty string; repeated rows get equal results, each its own; an empty table gives an empty table. Other columns
are not read, so their names can't clash; `keep` names those that go along and must not be named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")

_DELIMITER, _ESCAPE = "\x02", "\x01"


def _escaped(text: Column) -> Column:
    """No delimiter is left; every escape sign is followed by `e` (for itself) or `d` (for the delimiter)."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_DELIMITER), F.lit(_ESCAPE + "d"))


def _plain(part: Column) -> Column:
    """A stretch of units without the delimiters between them, unescaped."""
    bare = F.replace(part, F.lit(_DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "d"), F.lit(_DELIMITER)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _first(text: Column, mark: str, count: Column | int) -> Column:
    """substring_index with a count that is a column."""
    return F.call_function("substring_index", text, F.lit(mark), count.cast("int") if isinstance(count, Column) else F.lit(count))


def _check(markers: tuple[str, str, str]) -> None:
    """Three markers of which none holds another and none begins with what one ends with: then none can arise across a border."""
    pairs = [(a, b) for a in markers for b in markers]
    held = any(a in b for a, b in pairs if a is not b)
    if len(set(markers)) != 3 or not all(markers) or held or any(b.startswith(a[-k:]) for a, b in pairs for k in range(1, min(len(a), len(b)))):
        raise ValueError(f"markers {markers} could be taken for one another")


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    unit: str = LINES,
    markers: tuple[str, str, str] = MARKERS,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row a document: id, `keep`, n (units), form (`plain`, `psm`, `spm`), prefix, middle, suffix (null if plain) and output.

    Of all documents that can be cut, `fim_percent` in a hundred are; of these, `spm_percent` in a hundred put the suffix first. The
    units that `unit` matches, left to right, must cover the whole text. `markers` are those before prefix, suffix and middle.
    """
    if not (0 <= fim_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("fim_percent and spm_percent are 0 to 100")
    _check(markers)
    before, after, between = markers
    own = [f"`{c}`" for c in [id_col, *(keep or [])]]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    text, digest = F.col("_text"), F.col("_digest")
    step = docs.select(*own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.sha2(F.concat(F.lit(f"{seed}:"), key), 256).alias("_digest"))
    step = step.select(*own, text, digest, F.regexp_replace(_escaped(text), unit, "$0" + _DELIMITER).alias("_units"))
    step = step.select(*own, text, digest, "_units", (F.char_length("_units") - F.char_length(F.replace(F.col("_units"), F.lit(_DELIMITER), F.lit("")))).cast("long").alias("n"))
    cuts = [_draw(digest, k) % (F.col("n") + 1) for k in (0, 1)]
    marked = F.contains(text, F.lit(before)) | F.contains(text, F.lit(after)) | F.contains(text, F.lit(between))
    form = F.when((text == "") | marked | (_draw(digest, 2) % 100 >= fim_percent), "plain").when(_draw(digest, 3) % 100 < spm_percent, "spm").otherwise("psm")
    step = step.select(*own, text, "_units", "n", F.least(*cuts).alias("_from"), F.greatest(*cuts).alias("_to"), form.alias("form"))
    units, first, last, n = (F.col(c) for c in ("_units", "_from", "_to", "n"))
    # the delimiter stands behind every unit: the last-th one from the left is the (n - last + 1)-th from the right
    parts = {
        "prefix": _first(units, _DELIMITER, first),
        "middle": _first(_first(units, _DELIMITER, last), _DELIMITER, first - last),
        "suffix": _first(units, _DELIMITER, last - n - 1),
    }
    cut = F.col("form") != "plain"
    step = step.select(*own, "n", "form", text, *[F.when(cut, _plain(p)).alias(name) for name, p in parts.items()])
    prefix, middle, suffix = (F.col(c) for c in parts)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(before), prefix, F.lit(after), suffix, F.lit(between), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(after), suffix, F.lit(before), prefix, F.lit(between), middle))
        .otherwise(text)
    )
    return step.select(*own, "n", "form", *parts, output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text before `transform`, from its output and form alone.

    A cut text holds no marker, and none can arise across a border (`_check`), so each occurs once.
    """
    before, after, between = markers
    rest, middle = _first(output, between, 1), _first(output, between, -1)
    psm = F.concat(_first(_first(rest, after, 1), before, -1), middle, _first(rest, after, -1))
    spm = F.concat(_first(rest, before, -1), middle, _first(_first(rest, before, 1), after, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(found: DataFrame, id_col: str = "doc_id", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Lengths of the parts in code points, digests of the output and of the text rebuilt from it."""
    return found.select(
        id_col,
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), markers), 256).alias("restored_sha256"),
    )
