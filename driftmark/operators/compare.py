"""Comparisons of groups of windows: features, labels and animals, each as one grouped pass over all pairs of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.operators import stats
from driftmark.operators.transitions import group_pairs

TOO_FEW = "too few samples for statistical testing"


def in_pairs(table: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """Each row once for every pair (group_a, group_b) that its group is in, with side a or b. Pairs are few."""
    a = pairs.select("group_a", "group_b", F.col("group_a").alias(group), F.lit("a").alias("side"))
    b = pairs.select("group_a", "group_b", F.col("group_b").alias(group), F.lit("b").alias("side"))
    return table.join(a.unionByName(b), group)


def features(table: DataFrame, keys: Sequence[str], feature: str, value: str, side: str, first: object, second: object, medians: DataFrame | None = None) -> DataFrame:
    """All tests of two sides by key and feature: sizes, means, deviations, Cohen's d, log2 fold change, odds of being above the median with Fisher's p, U and its p.

    table is long: one row for each window and feature. The median is that of `medians` (feature, median) or of the table's own rows.
    Features with fewer than two values on a side are left out.
    """
    by = [*keys, feature]
    rows = table.where(F.col(value).isNotNull())
    effect = stats.enrichment(rows, by, value, side, first, second, medians=medians)
    is_a = F.col(side) == F.lit(first)
    spread = rows.where(F.col(side).isin(first, second)).groupBy(*by).agg(F.stddev_samp(F.when(is_a, F.col(value))).alias("sd_a"), F.stddev_samp(F.when(~is_a, F.col(value))).alias("sd_b"))
    ranks = stats.mann_whitney(rows, by, value, side, first, second).select(*by, "u", "p")
    return effect.where("n_a >= 2 AND n_b >= 2").join(spread, by).join(ranks, by)


def feature_pairs(table: DataFrame, feature: str, value: str, group: str, least: int = 5) -> DataFrame:
    """`features` of all pairs of groups, with the medians of all rows. Pairs with fewer than `least` rows on a side have one row with a note and no tests."""
    pairs = group_pairs(table, group)
    counted = table.where(F.col(value).isNotNull())
    sizes = counted.groupBy(group, feature).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.max("n").alias("n"))
    sized = pairs.join(sizes.select(F.col(group).alias("group_a"), F.col("n").alias("_a")), "group_a", "left").join(sizes.select(F.col(group).alias("group_b"), F.col("n").alias("_b")), "group_b", "left")
    few = (F.coalesce("_a", F.lit(0)) < least) | (F.coalesce("_b", F.lit(0)) < least)
    medians = stats.quantiles(counted, [feature], value, [0.5]).select(feature, F.col("_q")[0].alias("median"))
    tested = features(in_pairs(table, group, sized.where(~few).select("group_a", "group_b")), ["group_a", "group_b"], feature, value, "side", "a", "b", medians)
    noted = sized.where(few).select("group_a", "group_b", F.lit(TOO_FEW).alias("note"))
    return tested.withColumn("note", F.lit(None).cast("string")).unionByName(noted, allowMissingColumns=True)


def label_pairs(labels: DataFrame, group: str, label: str = "cluster", least: int = 5) -> DataFrame:
    """Of all pairs of groups and each label: windows of either group in it and their shares, odds ratio and Fisher's p; null tests and a note for small groups."""
    counts = labels.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    spine = group_pairs(labels, group).join(labels.select(label).distinct())  # groups and labels are few
    side = lambda s: totals.select(F.col(group).alias(f"group_{s}"), F.col("total").alias(f"n_{s}"))
    inside = lambda s: counts.select(F.col(group).alias(f"group_{s}"), label, F.col("n").alias(f"{s}_in"))
    out = spine.join(side("a"), "group_a").join(side("b"), "group_b").join(inside("a"), ["group_a", label], "left").join(inside("b"), ["group_b", label], "left")
    out = out.withColumn("a", F.coalesce("a_in", F.lit(0))).withColumn("b", F.coalesce("b_in", F.lit(0))).withColumn("c", F.col("n_a") - F.col("a")).withColumn("d", F.col("n_b") - F.col("b"))
    few = (F.col("n_a") < least) | (F.col("n_b") < least)
    tested = stats.fisher(out)
    return tested.select("group_a", "group_b", label, "n_a", "n_b", F.col("a").alias("a_in"), F.col("b").alias("b_in"), (F.col("a") / F.col("n_a")).alias("a_share"), (F.col("b") / F.col("n_b")).alias("b_share"), F.when(~few, F.col("odds_ratio")).alias("odds_ratio"), F.when(~few, F.col("p")).alias("p"), F.when(few, TOO_FEW).alias("note"))


def valid_kind(kind: Column) -> Column:
    """Whether an interaction type is one of two known animals."""
    return ~F.lower(kind).contains("single") & ~F.lower(kind).contains("unknown")


def housing_labels(windows: DataFrame, a: str, b: str, kind: str, label: str = "cluster") -> DataFrame:
    """Of each label: size, share, windows with an isolated animal and of grouped ones only, in it and outside, odds ratio and Fisher's p.

    Only windows of valid kinds count for the test. A label that holds all windows has no test.
    """
    ok = valid_kind(F.col(kind))
    alone = ok & ((F.col(a) == "isolated") | (F.col(b) == "isolated"))
    counts = windows.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.count_if(alone).alias("a"), F.count_if(ok & ~alone).alias("b"))
    total = lambda c: F.sum(c).over(W.partitionBy())  # noqa: E731  over a row for each label
    out = counts.select(label, "size", (F.col("size") / total("size")).alias("share"), "a", "b", (total("a") - F.col("a")).alias("c"), (total("b") - F.col("b")).alias("d"))
    out = stats.fisher(out)
    tested = F.col("share") < 1
    return out.select(label, "size", "share", F.col("a").alias("isolated_in"), F.col("b").alias("group_in"), F.col("c").alias("isolated_out"), F.col("d").alias("group_out"), F.when(tested, F.col("odds_ratio")).alias("odds_ratio"), F.when(tested, F.col("p")).alias("p"))


def condition_counts(windows: DataFrame, a: str, b: str, label: str = "cluster") -> DataFrame:
    """Animals of each condition in each label's windows, both of a window, with their share of the label's animals."""
    both = windows.select(label, F.explode(F.array(a, b)).alias("condition"))
    counts = both.groupBy(label, "condition").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(label)))


def first_two_kinds(long: DataFrame, kind: str, feature: str, value: str, least: int = 5) -> DataFrame:
    """`features` of the first two valid interaction types in the order of their names; no rows if there is one only, or one is small."""
    kinds = long.where(valid_kind(F.col(kind))).select(kind).distinct().orderBy(kind).limit(2).collect()
    if len(kinds) < 2:
        return features(long.limit(0), [], feature, value, kind, "", "")
    first, second = kinds[0][0], kinds[1][0]
    out = features(long, [], feature, value, kind, first, second)
    return out.withColumn("kind_a", F.lit(first)).withColumn("kind_b", F.lit(second)).where((F.col("n_a") >= least) & (F.col("n_b") >= least))


def describe(windows: DataFrame, kind: str, label: str = "cluster") -> DataFrame:
    """Labels of single animals without tests: size, share, and windows of each interaction type as a map."""
    counts = windows.groupBy(label, kind).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(label).agg(F.sum("n").alias("size"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("kinds"))  # types are few
    return out.withColumn("share", F.col("size") / F.sum("size").over(W.partitionBy()))


def animal_means(windows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of the known values of each animal's windows, by key."""
    return windows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def alone_against_paired(alone: DataFrame, paired: DataFrame, key: str, feature: str = "feature", value: str = "value", least: int = 3) -> DataFrame:
    """Of each feature, animals alone against the same ones paired: n, means, their difference, Wilcoxon's W and p, and U and p of the values unpaired.

    Both tables are long and have a row for each animal and feature; animals in both count, features with fewer than `least` are left out.
    """
    both = alone.select(key, feature, F.col(value).alias("x")).join(paired.select(key, feature, F.col(value).alias("y")), [key, feature]).where("x IS NOT NULL AND y IS NOT NULL")
    means = both.groupBy(feature).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_alone"), F.avg("y").alias("mean_paired")).where(F.col("n") >= least)
    signed = stats.signed_rank(both, [feature], "x", "y", least=1).select(feature, F.col("w"), F.col("p").alias("w_p"))
    sides = both.select(feature, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("x").alias("v")), F.struct(F.lit("b").alias("side"), F.col("y").alias("v")))).alias("s")).select(feature, "s.*")
    ranks = stats.mann_whitney(sides, [feature], "v", "side", "a", "b").select(feature, "u", F.col("p").alias("u_p"))
    return means.withColumn("diff", F.col("mean_paired") - F.col("mean_alone")).join(signed, feature, "left").join(ranks, feature)


def alone_by_housing(alone: DataFrame, housing: str, feature: str = "feature", value: str = "value", first: str = "SH", second: str = "GH", least: int = 2) -> DataFrame:
    """Of each feature, animals housed singly against grouped ones, both alone: sizes, means, U and p."""
    means = alone.where(F.col(value).isNotNull()).groupBy(feature).agg(F.avg(F.when(F.col(housing) == first, F.col(value))).alias("mean_a"), F.avg(F.when(F.col(housing) == second, F.col(value))).alias("mean_b"))
    return stats.mann_whitney(alone, [feature], value, housing, first, second).where((F.col("n_a") >= least) & (F.col("n_b") >= least)).join(means, feature)


def by_p(tests: DataFrame, p: str = "p", ties: Sequence[str] = ()) -> DataFrame:
    """Adds each test's place in the order of p, those without one last. Tests are few."""
    return tests.withColumn("place", F.row_number().over(W.orderBy(F.col(p).asc_nulls_last(), *ties)))


def run_summary(labels: DataFrame, group: str, label: str = "cluster", order: str = "start_frame", video: str = "video_id") -> DataFrame:
    """One row for a run: windows, labels and their sizes, groups and theirs, pairs of groups and transitions."""
    sizes = lambda c: labels.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias(f"n_{c}"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(c).cast("string").alias("k"), "n"))), lambda s: F.concat_ws(":", s["k"], s["n"].cast("string"))), ",").alias(f"{c}_sizes"))
    steps = labels.select(F.lead(label).over(W.partitionBy(video).orderBy(order)).alias("t")).agg(F.count("t").alias("n_transitions"))
    out = labels.agg(F.count(F.lit(1)).alias("n_windows")).join(sizes(label)).join(sizes(group)).join(steps)  # a row each
    return out.withColumn("n_pairs", F.expr(f"n_{group} * (n_{group} - 1) div 2"))


def name_order(table: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row in the order of its name without regard to case; equal ones by the name as it is. For lists of projects."""
    return table.withColumn("place", F.row_number().over(W.orderBy(F.lower(name), name)))


def largest_blobs(blobs: DataFrame, keys: Sequence[str], area: str, cx: str, tie: str, most: int = 4) -> DataFrame:
    """The `most` largest blobs of each key, numbered from left to right."""
    top = blobs.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(area), tie))).where(F.col("_r") <= most).drop("_r")
    return top.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(cx, tie)))


def listed_names(rows: DataFrame, state: str = "state_json") -> DataFrame:
    """Adds project_name and video_name of saved runs (project_id, video_id) from their state, a JSON text; the ids where it has none or is none."""
    parsed = F.from_json(F.col(state), "project_name string, videos array<struct<id: string, name: string>>")
    named = rows.withColumn("_s", parsed)
    own = F.filter("_s.videos", lambda v: v["id"] == F.col("video_id").cast("string"))
    named = named.withColumn("project_name", F.coalesce(F.nullif(F.col("_s.project_name"), F.lit("")), F.col("project_id").cast("string")))
    return named.withColumn("video_name", F.coalesce(F.nullif(F.try_element_at(own, F.lit(1))["name"], F.lit("")), F.col("video_id").cast("string"))).drop("_s")
