"""Label sequences: their order, transitions between consecutive labels, and comparisons of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequences(labels: DataFrame, video: str = "video_id", order: str = "start_frame", label: str = "cluster") -> DataFrame:
    """One row per video: its labels in order, and the label of its first window."""
    both = F.sort_array(F.collect_list(F.struct(order, label)))  # a video's windows
    return labels.groupBy(video).agg(both.alias("_s"), F.min_by(label, order).alias("first_label")).select(video, F.size("_s").alias("n_windows"), F.col("_s")[label].alias("labels"), "first_label")


def pairs(labels: DataFrame, keys: Sequence[str], order: str = "start_frame", label: str = "cluster", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each window that has a next one: from_label and to_label."""
    nxt = F.lead(label).over(W.partitionBy(*keys).orderBy(order))
    return labels.select(*keys, *keep, F.col(label).alias("from_label"), nxt.alias("to_label")).where("from_label IS NOT NULL AND to_label IS NOT NULL")


def matrix(steps: DataFrame, groups: Sequence[str] = (), loops: bool = True) -> DataFrame:
    """Counts and row-normalised probabilities of transitions by group; without loops from a label to itself if asked."""
    kept = steps if loops else steps.where("from_label <> to_label")
    counts = kept.groupBy(*groups, "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*groups, "from_label")))


def group_matrices(labels: DataFrame, group: str, video: str = "video_id", order: str = "start_frame", label: str = "cluster", exclude: Sequence[str] = ("unknown", "single_animal"), least: int = 2) -> DataFrame:
    """Matrices of each group with its videos, windows and transitions; excluded groups and videos with fewer than `least` windows are left out."""
    kept = labels.where(~F.col(group).isin(*exclude)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(video))).where(F.col("_n") >= least)
    sizes = kept.groupBy(group).agg(F.countDistinct(video).alias("n_videos"), F.count(F.lit(1)).alias("n_windows"))
    m = matrix(pairs(kept, [video], order, label, [group]), [group])
    totals = m.groupBy(group).agg(F.sum("n").alias("n_transitions"))
    return m.join(sizes, group).join(totals, group)


def group_pairs(groups: DataFrame, group: str) -> DataFrame:
    """All pairs a < b of the distinct groups, of which there are few."""
    one = groups.select(group).distinct()
    return one.select(F.col(group).alias("group_a")).join(one.select(F.col(group).alias("group_b")), F.col("group_a") < F.col("group_b"))


def differences(m: DataFrame, group: str) -> DataFrame:
    """p of the first less p of the second group for all pairs of groups, labels missing on one side being 0, and the pair's largest absolute difference."""
    ordered = group_pairs(m, group)
    a = m.select(F.col(group).alias("group_a"), "from_label", "to_label", F.col("p").alias("p_a"))
    b = m.select(F.col(group).alias("group_b"), "from_label", "to_label", F.col("p").alias("p_b"))
    cells = ordered.join(a, "group_a").select("group_a", "group_b", "from_label", "to_label", "p_a", F.lit(0.0).alias("p_b"))
    other = ordered.join(b, "group_b").select("group_a", "group_b", "from_label", "to_label", F.lit(0.0).alias("p_a"), "p_b")
    out = cells.unionByName(other).groupBy("group_a", "group_b", "from_label", "to_label").agg((F.sum("p_a") - F.sum("p_b")).alias("diff"))
    return out.withColumn("largest", F.max(F.abs("diff")).over(W.partitionBy("group_a", "group_b")))


def composition(labels: DataFrame, group: str, label: str = "cluster") -> DataFrame:
    """Windows of each group and label, 0 where there is none, with shares of the group and of all."""
    spine = labels.select(group).distinct().join(labels.select(label).distinct())
    counts = labels.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    out = spine.join(counts, [group, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(group)))).withColumn("group_share", F.sum("n").over(W.partitionBy(group)) / F.sum("n").over(W.partitionBy()))


def shares_by_video(labels: DataFrame, video: str = "video_id", label: str = "cluster", keep: Sequence[str] = ()) -> DataFrame:
    """Share of each label in its video's windows."""
    counts = labels.groupBy(video, *keep, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(video)))


def label_summary(labels: DataFrame, values: Sequence[str], label: str = "cluster") -> DataFrame:
    """Size, share and mean values of each label."""
    out = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
