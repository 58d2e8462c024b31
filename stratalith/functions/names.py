"""Columns over sample names, image names, model and feature names.

A sample name is a composite key in a string: `date--s--species--st--label--p--well--posNNN--tm--time--ch--channel--z--z`; file names have `_`
for `--`. Every function takes and returns columns, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the image name format, families of generated features, labels that count as none
IMAGE_PATTERN = r"(?i)^(\d{8})[-_]s[-_]([^_-]+)[-_]st[-_]([^_-]+)[-_]p[-_]([^_-]+)[-_]pos([^_-]+)[-_]tm[-_]([^_-]+)[-_]ch[-_]([^_-]+)[-_]z[-_]([^_-]+)$"
NAME_FIELDS = ["date", "species", "label", "well", "position", "time", "channel", "z"]
FEATURE_PREFIXES = ["counts", "diff", "max", "med", "mean", "std", "min", "minProp", "BioVolume", "Substratum", "Homogen", "Spreading", "GPT", "CustomAlgos", "DiffGlobal", "eigen", "globalMean", "mdiffs", "RoughnessThreshold", "ThicknessThreshold", "Area2D", "surf3D", "vol3D", "compactness"]
NO_LABELS = ["", "unknown", "missing", "unlabelled", "unlabeled"]
LEARNERS = {"rf": "Random forest", "dummy": "Majority baseline", "decisiontree": "Decision tree", "logistic": "Logistic regression", "xgb": "Gradient boosting", "gridsearch": "Nearest neighbours"}
LEARNER_CLASSES = [("randomforestclassifier", "rf"), ("dummyclassifier", "dummy"), ("decisiontreeclassifier", "decisiontree"), ("logisticregression", "logistic"), ("xgbclassifier", "xgb"), ("gridsearchcv", "gridsearch"), ("kneighborsclassifier", "gridsearch")]
LEGACY_SVD = [16, 32, 64, 128, 256, 512]
# fixed values: preprocessing settings, in order of report: key, other spelling, words
SETTINGS = [("all_columns", "all", "All generated columns"), ("threshold_only", None, "Threshold-derived columns only")]
# fixed values: where a name of other separators has its fields: the token looked for (none: the first), steps behind it, and what a field's token begins with
TOKEN_PLACES = {"date": (None, 0, ""), "species": (None, 2, ""), "label": ("st", 1, ""), "well": ("p", 1, ""), "position": ("p", 2, "pos"), "time": ("p", 3, "tm"), "channel": ("p", 4, "ch"), "z": ("p", 5, "z")}


def token(name: Column, i: int) -> Column:
    """0-based `--` token; null beyond the last."""
    return F.get(F.split(name, "--"), F.lit(i))


def without_position(name: Column) -> Column:
    """The name without any token that holds `pos`."""
    return F.array_join(F.filter(F.split(name, "--"), lambda t: ~F.contains(t, F.lit("pos"))), "--")


def sample_from_file(base: Column, identifiers: tuple[str, ...] = ("CustomAlgos", "DiffGlobal")) -> Column:
    """Sample name of a per-image file: namespace ids and the suffix go, `_` becomes `--`."""
    for x in identifiers:
        base = F.replace(base, F.lit(x), F.lit(""))
    return F.replace(F.regexp_replace(base, r"\.txt$", ""), F.lit("_"), F.lit("--"))


def namespace_of(path: Column, identifiers: tuple[str, ...] = ("CustomAlgos", "DiffGlobal")) -> Column:
    """The first identifier found in the base name of a path (not in its folders), or null."""
    base = F.substring_index(path, "/", -1)
    out = F.lit(None).cast("string")
    for x in reversed(identifiers):
        out = F.when(F.contains(base, F.lit(x)), F.lit(x)).otherwise(out)
    return out


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def image_field(name: Column, field: str) -> Column:
    """One field of a well-formed image name, empty if it doesn't fit the format."""
    return F.regexp_extract(name, IMAGE_PATTERN, NAME_FIELDS.index(field) + 1)


def is_image_name(name: Column) -> Column:
    return F.rlike(name, F.lit(IMAGE_PATTERN))


def sample_fields(sample: Column) -> Column:
    """All fields of a sample or file name as an array in the order of NAME_FIELDS, or null.

    A name of the format is matched once, whatever its separators. Any other name has its fields by token if it has 14 tokens, eight digits
    first, and none of its fields is missing.
    """
    bare = stem(F.substring_index(F.replace(sample, F.lit("--"), F.lit("_")), "/", -1))
    matched = F.split(F.regexp_replace(bare, IMAGE_PATTERN, "\u0000".join(f"${i + 1}" for i in range(len(NAME_FIELDS)))), "\u0000")
    tokens = F.filter(F.split(stem(F.substring_index(sample, "/", -1)), "[-_]+"), lambda t: t != "")

    def place(mark: str | None, steps: int) -> Column:
        # array_position counts from 1 and gives 0 for none: null then, as is what lies behind the last token
        return F.lit(steps + 1) if mark is None else F.nullif(F.array_position(tokens, mark), F.lit(0).cast("long")).cast("int") + steps

    found = F.array(*[F.regexp_replace(F.get(tokens, place(mark, steps) - 1), f"^{prefix}", "") for mark, steps, prefix in (TOKEN_PLACES[f] for f in NAME_FIELDS)])
    whole = (F.size(tokens) >= 14) & F.rlike(F.get(tokens, F.lit(0)), F.lit(r"^\d{8}$")) & ~F.exists(found, lambda t: t.isNull())
    return F.when(F.size(matched) == len(NAME_FIELDS), matched).when(whole, found)


def sample_field(sample: Column, field: str) -> Column:
    """One field of a sample name, null if the name doesn't tell. Several are cheaper from one `sample_fields`."""
    return F.get(sample_fields(sample), F.lit(NAME_FIELDS.index(field)))


def replication_group(sample: Column, unit: str) -> Column:
    """`date`, `date::well` or `date::well::position`."""
    parts = {"date": 1, "well": 2, "position": 3}
    if unit not in parts:
        raise ValueError("replication unit must be date, well, or position")
    return F.concat_ws("::", *[sample_field(sample, f) for f in ("date", "well", "position")[: parts[unit]]])


def date_and_strain(sample: Column) -> Column:
    return F.concat_ws("::", F.substring(sample, 1, 8), F.regexp_extract(sample, "st--([^-_]+)-", 1))


def pool(sample: Column) -> Column:
    """The strain of a sample; empty if the name doesn't tell."""
    return F.regexp_extract(sample, "st[-_]{1,2}([^-_]+)[-_]?", 1)


def sub_pool(sample: Column) -> Column:
    """date::well, the date and well being those that a greedy search finds."""
    pattern = r"(\d{8}).+p[-_]{1,2}([^-_]+)[-_]?"
    return F.concat_ws("::", F.regexp_extract(sample, pattern, 1), F.regexp_extract(sample, pattern, 2))


def is_generated_feature(feature: Column) -> Column:
    out = F.lit(False)
    for p in FEATURE_PREFIXES:
        out = out | F.startswith(feature, F.lit(p))
    return out


def has_label(label: Column) -> Column:
    return label.isNotNull() & ~F.lower(F.trim(label)).isin(NO_LABELS)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "1", "yes")


def canonical_learner(name: Column) -> Column:
    """Stable key of a learner by its current or legacy name."""
    raw = F.trim(F.regexp_replace(name, r"\s+", " "))
    low = F.lower(raw)
    out = F.when(low.isin(*LEARNERS), low)
    for part, key in LEARNER_CLASSES:
        out = out.when(F.contains(low, F.lit(part)), F.lit(key))
    return out.otherwise(F.when(raw == "", F.lit("model")).otherwise(raw))


def safe_report_name(name: Column, longest: int = 80) -> Column:
    """File-name-safe learner name; too long ones end in twelve hex digits of the raw name's SHA-256."""
    squeezed = F.trim(F.regexp_replace(name, r"\s+", " "))
    raw = F.when(squeezed == "", F.lit("model")).otherwise(squeezed)
    safe = F.regexp_replace(F.regexp_replace(canonical_learner(raw), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    safe = F.when(safe == "", F.lit("model")).otherwise(safe)
    return F.when(F.length(safe) > longest, F.concat(F.regexp_replace(F.substring(safe, 1, longest - 13), "_+$", ""), F.lit("_"), F.substring(F.sha2(raw, 256), 1, 12))).otherwise(safe)


def configuration_key(setting: Column, components: Column, threshold_flag: Column) -> Column:
    """One key for a preprocessing configuration: what a result names, else an SVD by its number of components if that is one that was published, else what the flag says.

    Results without a setting have the number of columns itself where no SVD was made, so any other number is no SVD.
    """
    named = F.nullif(F.nullif(F.lower(F.trim(setting)), F.lit("")), F.lit("nan"))
    count = F.trim(components).try_cast("double").cast("int")
    published = F.when(F.array_contains(F.array(*[F.lit(n) for n in LEGACY_SVD]), count), F.concat(F.lit("svd_"), count.cast("string")))
    by_flag = F.get(F.array(*[F.lit(key) for key, _, _ in SETTINGS]), (~F.coalesce(truthy(threshold_flag), F.lit(True))).cast("int"))
    return F.coalesce(named, published, by_flag)


def _setting_number(key: Column) -> Column:
    """The place of a key in SETTINGS under either spelling, else null."""
    return F.coalesce(*[F.when(key.isin(*[k for k in spellings if k]), F.lit(i)) for i, spellings in enumerate((key, other) for key, other, _ in SETTINGS)])


def configuration_display(key: Column) -> Column:
    """Words for a configuration key."""
    parts = F.split(F.regexp_replace(key, "^svd_(.+?)(?:_(all_columns|threshold_only))?$", "svd\u0000$1\u0000$2"), "\u0000")
    note = F.when(F.get(parts, F.lit(2)) == "threshold_only", " (threshold-derived input)").otherwise("")
    words = F.lower(F.replace(key, F.lit("_"), F.lit(" ")))
    return F.coalesce(
        F.get(F.array(*[F.lit(told) for _, _, told in SETTINGS]), _setting_number(key)),
        F.when(F.size(parts) == 3, F.concat(F.lit("SVD "), F.get(parts, F.lit(1)), F.lit(" components"), note)),
        F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000)),
    )


def configuration_order(key: Column) -> Column:
    """Sorts configurations as reports have them: SETTINGS first, then by number of components, those without a number last."""
    number = F.regexp_extract(key, "^svd_([0-9.]+)", 1).try_cast("double")
    rank = _setting_number(key)
    return F.struct(F.coalesce(rank, F.lit(len(SETTINGS))).alias("kind"), F.when(rank.isNotNull(), 0.0).otherwise(F.coalesce(number, F.lit(float("inf")))).alias("n"), key.alias("key"))


def classification_scope(file_stem: Column) -> Column:
    """Prefix that keeps reports of benchmark variants apart."""
    scope = F.regexp_replace(file_stem, "^classification_", "")
    safe = F.regexp_replace(F.regexp_replace(scope, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(scope.isin("", "classification"), F.lit("")).otherwise(F.concat(safe, F.lit("_")))


def classification_title(file_stem: Column) -> Column:
    """Words for a benchmark variant, from the same name as its scope."""
    scope = F.regexp_replace(file_stem, "^classification_", "")
    words = F.lower(F.replace(scope, F.lit("_"), F.lit(" ")))
    told = F.when(scope.isin("", "classification", "all"), "All generated columns").when(scope == "no_counts_features", "Without count-derived columns")
    return told.otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000)))


def disk_name(feature: Column) -> Column:
    """A feature name that can be a file name."""
    out = feature
    for a, b in (("(", "-"), ("<", "_lt_")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def feature_name(measure: Column, namespace: Column, statistic: Column) -> Column:
    """`<measure>-SUMMARY<namespace>.tsv_<statistic>.txt`"""
    return F.concat(measure, F.lit("-SUMMARY"), namespace, F.lit(".tsv_"), statistic, F.lit(".txt"))
