"""Folds: stratified, grouped, leave one group out, pools of groups; checks that a plan of folds is feasible.

Order comes from MD5 of the key, so that a fold is the same on any cluster and can be told in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stratified_folds(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """`fold` from 0 to k - 1, dealt evenly within each label.

    A label with a third of all rows isn't sorted in one task: rows are numbered within hash slices of each label, whose sizes
    are summed on the side.
    """
    slice_ = F.substring(F.md5(F.col(key).cast("string")), 1, 2)
    rows = rows.withColumn("_m", F.md5(F.col(key).cast("string"))).withColumn("_s", slice_)
    sizes = rows.groupBy(label, "_s").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(label).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(label, "_s").orderBy("_m", key)))
    return numbered.join(before, [label, "_s"]).withColumn("fold", ((F.col("_before") + F.col("_n") - 1) % k).cast("int")).drop("_m", "_s", "_n", "_before")


def ordered_folds(rows: DataFrame, label: str, key: str, k: int = 10) -> DataFrame:
    """`fold` from 0 to k - 1, each label's rows in order of the key as k runs: stratified folds without a shuffle.

    Labels in order are dealt to folds in turn as if they stood in one line, which tells how many rows of a label a fold has; its runs are of those lengths.
    """
    counts = rows.groupBy(label).count()
    ends = counts.withColumn("_end", F.sum("count").over(Window.orderBy(label)))
    upto = lambda n, i: F.floor((n - 1 - i) / k) + 1  # noqa: E731  places below n that are i modulo k
    each = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (upto(F.col("_end"), i) - upto(F.col("_end") - F.col("count"), i)).cast("long"))
    bounds = ends.select(label, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(F.slice(each, F.lit(1), i), F.lit(0).cast("long"), lambda a, v: a + v)).alias("_bounds"))
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1)
    return placed.join(bounds, label).withColumn("fold", F.size(F.filter("_bounds", lambda b: b <= F.col("_n"))).cast("int")).drop("_n", "_bounds")


def fold_coverage(folded: DataFrame, label: str) -> DataFrame:
    """Per fold: rows, labels in it, and labels in all other folds."""
    counts = folded.groupBy("fold", label).count()
    totals = counts.groupBy(label).agg(F.sum("count").alias("all"))
    joined = counts.join(totals, label)
    return joined.groupBy("fold").agg(F.sum("count").alias("n"), F.count("*").alias("test_labels"), F.count_if(F.col("all") > F.col("count")).alias("train_labels_of_test"))


def adaptive_k(rows: DataFrame, label: str, most: int = 5) -> DataFrame:
    """Folds that every class can fill: the smallest class limits k; an error below two."""
    counts = rows.groupBy(label).count()
    least = F.min("count")
    return counts.agg(least.alias("smallest_class"), F.least(F.lit(most), least).cast("int").alias("k"), F.count("*").alias("classes"), (least >= 2).alias("feasible"))


def require_k(rows: DataFrame, label: str, most: int = 5) -> int:
    """adaptive_k's k, or an error if a class has fewer than two rows."""
    r = adaptive_k(rows, label, most).first()
    if r["smallest_class"] is None or r["smallest_class"] < 2:
        raise ValueError("each class requires at least 2 samples")
    return r["k"]


def leave_one_out(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Per test group: its size, and rows and groups to train on. Totals make the join of all pairs of groups needless."""
    sizes = rows.groupBy(group).agg(F.count(key).alias("test_n"))
    total = sizes.agg(F.sum("test_n").alias("all_n"), F.count("*").alias("groups"))
    return sizes.join(F.broadcast(total), how="cross").select(F.col(group).alias("test_group"), "test_n", (F.col("all_n") - F.col("test_n")).alias("train_n"), (F.col("groups") - 1).alias("train_groups"))


def shared_groups(folded: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one fold: none may, in a grouped plan."""
    return folded.groupBy(group).agg(F.countDistinct("fold").alias("folds")).filter("folds > 1")


def pool_ranks(rows: DataFrame, label: str, group: str) -> DataFrame:
    """The groups of each label in shuffled order: (label, group, pool_rank)."""
    groups = rows.select(label, group).distinct()
    return groups.withColumn("pool_rank", F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.col(group).cast("string")), group)))


def pooled_sizes(rows: DataFrame, label: str, group: str, counts: Sequence[int]) -> DataFrame:
    """Rows of the first n groups of every label, for each n: a learning curve's training sets."""
    ranked = rows.groupBy(label, group).count().join(pool_ranks(rows, label, group), [label, group])
    picked = ranked.withColumn("n_pools", F.explode(F.array(*[F.lit(n) for n in counts]))).filter(F.col("pool_rank") <= F.col("n_pools"))
    return picked.groupBy("n_pools", label).agg(F.sum("count").alias("n_rows"), F.count("*").alias("groups"))


def _counts(rows: DataFrame, label: str, group: str) -> dict:
    """Rows by group and label: as many numbers as an experiment has groups and labels, not its samples."""
    counts: dict = {}
    for r in rows.groupBy(group, label).count().collect():
        counts.setdefault(r[group], {})[r[label]] = r["count"]
    return counts


def _deal(counts: dict, k: int, home: dict) -> dict:
    """Every group without a fold to the one where its classes are fewest, large groups first."""
    labels = {x for c in counts.values() for x in c}
    load = [dict.fromkeys(labels, 0) for _ in range(k)]
    for g, f in home.items():
        for x, n in counts[g].items():
            load[f][x] += n
    home = dict(home)
    for g in sorted((g for g in counts if g not in home), key=lambda g: (-max(counts[g].values()), -sum(counts[g].values()), str(g))):
        home[g] = min(range(k), key=lambda f: (sum((load[f][x] + counts[g].get(x, 0)) ** 2 - load[f][x] ** 2 for x in labels), sum(load[f].values()), f))
        for x, n in counts[g].items():
            load[home[g]][x] += n
    return home


def _covers(counts: dict, k: int) -> dict | None:
    """Groups that give each of k folds every class, or None if no choice of groups does. Folds are filled one after the other, by trying and taking back.

    Groups with the same classes are alike here, so they are tried once; the class with the fewest groups left is served first; what was
    found impossible (groups left by kind, folds left, classes the open fold lacks) isn't tried again.
    """
    labels = frozenset(x for c in counts.values() for x in c)
    kinds: dict[frozenset, list] = {}
    for g in sorted(counts, key=lambda g: (sum(counts[g].values()), str(g))):
        kinds.setdefault(frozenset(counts[g]), []).append(g)
    order = sorted(kinds, key=lambda s: (len(s), sorted(map(str, s))))
    left, hopeless = [len(kinds[s]) for s in order], set()
    taken: list[tuple[int, int]] = []

    def fill(fold: int, lacks: frozenset) -> bool:
        if not lacks:
            fold, lacks = fold + 1, labels
        if fold == k:
            return True
        state = (tuple(left), fold, lacks)
        if state in hopeless:
            return False
        supply = {x: sum(n for s, n in zip(order, left, strict=True) if x in s) for x in labels}
        if all(supply[x] >= k - fold - (x not in lacks) for x in labels):
            scarce = min(lacks, key=lambda x: (supply[x], str(x)))
            for i in sorted((i for i, s in enumerate(order) if left[i] and scarce in s), key=lambda i: (-len(order[i] & lacks), len(order[i]))):
                left[i] -= 1
                taken.append((i, fold))
                if fill(fold, lacks - order[i]):
                    return True
                left[i] += 1
                taken.pop()
        hopeless.add(state)
        return False

    if not labels or not fill(0, labels):
        return None
    return {kinds[order[i]].pop(): fold for i, fold in taken}


def plan_groups(counts: dict, most: int) -> dict | None:
    """(group -> fold) of the largest number of folds up to `most` in which every fold tests, and all others train, every class; None if not even two can."""
    labels = {x for c in counts.values() for x in c}
    spread = min((sum(x in c for c in counts.values()) for x in labels), default=0)
    for k in range(min(most, spread), 1, -1):
        home = _deal(counts, k, {})
        if any({x for g in counts if home[g] == f for x in counts[g]} != labels for f in range(k)):
            cover = _covers(counts, k)
            home = None if cover is None else _deal(counts, k, cover)
        if home is not None:
            return home
    return None


def grouped_folds(rows: DataFrame, label: str, group: str, most: int = 5) -> DataFrame:
    """(group, fold): whole groups to folds, classes as even as can be, the largest k whose folds all train and test every class; an error only if no plan of two folds exists."""
    home = plan_groups(_counts(rows, label, group), most)
    if home is None:
        raise ValueError("no grouped plan has every class in every training and test fold")
    return rows.sparkSession.createDataFrame(sorted(home.items(), key=str), T.StructType([rows.schema[group], T.StructField("fold", T.IntegerType())]))


def feasibility(rows: DataFrame, label: str, group: str, outer: int = 3, inner: int = 5, nested: bool = True) -> dict:
    """Can grouped cross-validation be done, with tuning inside each outer fold if `nested`? Plans are made, not guessed: status suitable, limited (two folds somewhere) or unavailable, with the reasons."""
    counts = _counts(rows.filter(F.col(group).isNotNull() & F.col(label).isNotNull()), label, group)
    labels = sorted({x for c in counts.values() for x in c}, key=str)
    out = {"classes": len(labels), "groups": len(counts), "groups_per_class": {str(x): sum(x in c for c in counts.values()) for x in labels}, "outer": 0, "inner": [], "warnings": [], "errors": []}
    plan = plan_groups(counts, outer) if len(labels) > 1 else None
    if plan is None:
        out["errors"].append("fewer than two classes" if len(labels) < 2 else "no grouped plan has every class in every training and test fold")
    else:
        out["outer"] = max(plan.values()) + 1
        for f in range(out["outer"] if nested else 0):
            tuned = plan_groups({g: c for g, c in counts.items() if plan[g] != f}, inner)
            if tuned is None:
                out["errors"].append(f"nested model tuning has no plan of folds among the training groups of outer fold {f + 1}")
                break
            out["inner"].append(max(tuned.values()) + 1)
    out["ok"] = not out["errors"]
    if out["errors"]:
        out["reason"] = out["errors"][0]
    if out["ok"] and 2 in (out["outer"], *out["inner"]):
        out["warnings"].append("only two folds at one stage at least: estimates may be unstable")
    out["status"] = "unavailable" if out["errors"] else "limited" if out["warnings"] else "suitable"
    return out


def replication_report(rows: DataFrame, label: str, units: dict, outer: int = 3) -> DataFrame:
    """Per replication unit (name -> group column): groups, classes, fewest groups of a class, and whether grouped and nested folds are feasible."""
    out = None
    for name, group in units.items():
        per = rows.select(F.col(label).alias("label"), group.alias("g")).filter(F.col("g").isNotNull()).groupBy("label").agg(F.countDistinct("g").alias("n"))
        total = rows.select(group.alias("g")).agg(F.countDistinct("g").alias("groups"))
        least = F.coalesce(F.min("n"), F.lit(0))
        part = per.agg(F.count("*").alias("classes"), least.alias("fewest")).join(F.broadcast(total), how="cross")
        status = F.when((F.col("classes") < 2) | (F.col("fewest") < 2), "unavailable").when(F.col("fewest") < outer, "limited").otherwise("suitable")
        part = part.select(F.lit(name).alias("unit"), "groups", "classes", "fewest", status.alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def fixed_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the MD5 of their key: a background or a set of rows to explain that is the same on every run."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
