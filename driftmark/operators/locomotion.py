"""Distances walked by tracked objects, in windows and over whole tracks.

Tracks are dense: tracks(video_id, object_id, frame_idx, cx, cy), null where an object isn't seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions.scalars import diagonal, finite
from driftmark.operators import stats, windows

KEYS = ("video_id", "object_id")


def with_steps(tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds step, the distance from the previous frame; null unless both are seen."""
    return windows.steps(tracks, keys, ["cx", "cy"]).withColumn("step", F.hypot("d_cx", "d_cy"))


def path_lengths(tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum of steps between consecutive seen frames; 0 if there are none."""
    return with_steps(tracks, keys).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"))


def locomotion(tracks: DataFrame, chunk: int = 90, stride: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance inside each window, null if any of its frames is missing.

    Where the stride divides the chunk, sums over panes of `stride` frames are joined to windows; the step into a window's
    first frame, which the window doesn't own, is kept apart. Otherwise frames are repeated for each window.
    """
    stepped = with_steps(tracks, keys)
    if chunk % stride:
        inside = windows.sliding(stepped, keys, chunk, stride)
        own = F.when(F.col("frame_idx") > F.col("start_frame"), F.col("step"))
        seen = F.count(F.when(F.col("cx").isNotNull() & F.col("cy").isNotNull(), 1))
        return inside.groupBy(*keys, "start_frame").agg(F.when(seen == chunk, F.coalesce(F.sum(own), F.lit(0.0))).alias("distance"))
    sized = stepped.withColumn("_len", F.max("frame_idx").over(W.partitionBy(*keys)) + 1)
    sums = {
        "_seen": F.count(F.when(F.col("cx").isNotNull() & F.col("cy").isNotNull(), 1)),
        "_path": F.coalesce(F.sum("step"), F.lit(0.0)),
        "_into": F.coalesce(F.sum(F.when(F.col("frame_idx") % stride == 0, F.col("step"))), F.lit(0.0)),
    }
    paned = windows.panes(sized, [*keys, "_len"], stride, sums)
    first = paned.withColumn("_first", F.col("_into"))
    w = W.partitionBy(*keys).orderBy("pane").rangeBetween(0, chunk // stride - 1)
    out = first.select(*keys, "_len", (F.col("pane") * stride).alias("start_frame"), F.sum("_seen").over(w).alias("_seen"), (F.sum("_path").over(w) - F.col("_first")).alias("_path"))
    out = out.where(F.col("start_frame") + chunk <= F.col("_len"))
    return out.select(*keys, "start_frame", F.when(F.col("_seen") == chunk, F.greatest(F.col("_path"), F.lit(0.0))).alias("distance"))


def normalised(samples: DataFrame, value: str = "distance", width: str = "width", height: str = "height") -> DataFrame:
    """Adds <value>_norm, the value over the frame's diagonal."""
    return samples.withColumn(f"{value}_norm", F.col(value) / diagonal(F.col(width), F.col(height)))


def quantile_ranks(samples: DataFrame, keys: Sequence[str], value: str, name: str = "quantile") -> DataFrame:
    """Adds the share of the key's values that are at most this one; rows without a value are dropped."""
    return samples.where(F.col(value).isNotNull()).withColumn(name, F.cume_dist().over(W.partitionBy(*keys).orderBy(value)))


def snapshot(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation and 5th, 50th and 95th percentile (interpolated) by key, of the finite values; others don't count."""
    kept = samples.select(*keys, finite(F.col(value).cast("double")).alias(value)).where(F.col(value).isNotNull())
    out = kept.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    out = stats.joined(out, stats.quantiles(kept, keys, value, (0.05, 0.5, 0.95), "_p"), keys)
    return out.select(*keys, "n", "mean", "std", F.col("_p")[0].alias("p05"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p95"))


def pooled(samples: DataFrame, name: str, video: str, value: str, size: Column) -> DataFrame:
    """Windows pooled by object name: absolute and normalised distance and the mean of their ranks inside each track."""
    both = samples.where(F.col(value).isNotNull()).withColumn("_norm", F.col(value) / size)
    rank = lambda c: F.cume_dist().over(W.partitionBy(video, name).orderBy(c))
    ranked = both.select(name, video, value, "_norm", ((rank(value) + rank("_norm")) / 2).alias("_rank"))
    return ranked.groupBy(name).agg(F.count(value).alias("n"), F.countDistinct(video).alias("videos"), F.avg(value).alias("mean_abs"), F.avg("_norm").alias("mean_norm"), F.avg("_rank").alias("mean_rank"))
