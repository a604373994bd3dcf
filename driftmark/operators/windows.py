"""Sliding count windows over dense frame axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame_spine(videos: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """A row for each frame from start up to and without stop; none where stop <= start."""
    return videos.where(F.col(stop) > F.col(start)).select(*keys, F.explode(F.sequence(F.col(start), F.col(stop) - 1)).alias("frame_idx"))


def sliding(frames: DataFrame, keys: Sequence[str], chunk: int = 90, stride: int = 30, length: Column | None = None) -> DataFrame:
    """Each frame once for every window [s, s + chunk), s = 0, stride, ..., that lies whole in the axis and holds it.

    Adds start_frame. The axis ends after `length` frames; by default after the last frame of its keys, found by a
    window over the keys, so that a following operation on the same keys needs no other exchange.
    """
    total = length if length is not None else F.max("frame_idx").over(W.partitionBy(*keys)) + 1
    f = F.col("frame_idx")
    low = F.greatest(F.lit(0), F.ceil((f - (chunk - 1)) / stride)).cast("long")
    high = F.least(F.floor(f / stride), F.floor((F.col("_len") - chunk) / stride)).cast("long")
    held = frames.withColumn("_len", total).where(F.col("_len") >= chunk).withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi")
    starts = F.transform(F.sequence("_lo", "_hi"), lambda k: k * stride)
    return held.withColumn("start_frame", F.explode(starts)).drop("_len", "_lo", "_hi")


def steps(frames: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds d_<value>, the change since the previous frame of the same keys, and of none for the first."""
    order = W.partitionBy(*keys).orderBy("frame_idx")
    return frames.select("*", *[(F.col(v) - F.lag(v).over(order)).alias(f"d_{v}") for v in values])


def panes(frames: DataFrame, keys: Sequence[str], stride: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over panes of `stride` frames: pane number and one column for each of sums.

    Windows whose chunk is a multiple of the stride are unions of panes; `from_panes` joins them. Rows then grow with
    chunk / stride panes instead of frames.
    """
    return frames.groupBy(*keys, F.floor(F.col("frame_idx") / stride).alias("pane")).agg(*[c.alias(n) for n, c in sums.items()])


def from_panes(paned: DataFrame, keys: Sequence[str], chunk: int, stride: int, length: str, sums: Sequence[str]) -> DataFrame:
    """Sums over sliding windows from sums over panes. `length` is a column that holds the frames of the axis."""
    if chunk % stride:
        raise ValueError("the chunk must be a multiple of the stride")
    k = chunk // stride
    w = W.partitionBy(*keys).orderBy("pane").rangeBetween(0, k - 1)
    out = paned.select(*keys, length, (F.col("pane") * stride).alias("start_frame"), *[F.sum(s).over(w).alias(s) for s in sums])
    return out.where((F.col("start_frame") + chunk) <= F.col(length))
