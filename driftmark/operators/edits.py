"""Edits of frame tables as joins and unions: new tables come out, nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(column: str, first: int | None = None, last: int | None = None) -> Column:
    """Whether a frame lies in an inclusive range with open ends (null, or -1 for the last)."""
    ok = F.lit(True)
    if first is not None:
        ok = ok & (F.col(column) >= first)
    if last is not None and last != -1:
        ok = ok & (F.col(column) <= last)
    return ok


def swapped(table: DataFrame, a: str, b: str, first: int | None = None, last: int | None = None, frame: str = "frame_idx", obj: str = "object_id") -> DataFrame:
    """The table with objects a and b exchanged in a range of frames; doing it twice changes nothing."""
    inside = in_range(frame, first, last)
    new = F.when(inside & (F.col(obj) == a), b).when(inside & (F.col(obj) == b), a).otherwise(F.col(obj))
    return table.withColumn(obj, new)


def frames_with(table: DataFrame, objects: Sequence[str], first: int | None = None, last: int | None = None, frame: str = "frame_idx", obj: str = "object_id") -> DataFrame:
    """How many distinct frames of a range hold one of the objects: one row, frames."""
    return table.where(in_range(frame, first, last) & F.col(obj).isin(*objects)).agg(F.countDistinct(frame).alias("frames"))


def without_range(table: DataFrame, first: int | None = None, last: int | None = None, frame: str = "frame_idx") -> DataFrame:
    """The rows outside of a range of frames."""
    return table.where(~in_range(frame, first, last))


def upserted(base: DataFrame, new: DataFrame, emptied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the keys of new and of emptied replaced by the rows of new. A new row without a box keeps the old one."""
    touched = new.select(*keys).unionByName(emptied.select(*keys)).distinct()
    old = base.select(*keys, F.col("box").alias("_box"))
    rows = new.join(old, list(keys), "left").withColumn("box", F.coalesce("box", "_box")).select(*base.columns)
    return base.join(touched, list(keys), "left_anti").unionByName(rows)


def first_of(primary: DataFrame, legacy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of primary, and what legacy has under other keys."""
    return primary.unionByName(legacy.join(primary.select(*keys).distinct(), list(keys), "left_anti"))


def migrated(masks: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Masks with their boxes, or boxes derived from them, and counts: seen, imported, boxes missing. masks: keys, area, derived."""
    out = masks.join(boxes, list(keys), "left").withColumn("_missing", F.col("box").isNull())
    counts = out.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("area") > 0).alias("imported"), F.count_if(F.col("_missing")).alias("box_missing"))
    return out.where("area > 0").select(*keys, "area", F.coalesce("box", "derived").alias("box")), counts


def verified(old: DataFrame, new: DataFrame, keys: Sequence[str], exact: str, close: str, within: float = 1e-5) -> DataFrame:
    """Keys of either table and how they compare: row missing, mask differs, box differs, same."""
    left = old.select(*keys, F.col(exact).alias("_e0"), F.col(close).alias("_c0"), F.lit(True).alias("_in0"))
    right = new.select(*keys, F.col(exact).alias("_e1"), F.col(close).alias("_c1"), F.lit(True).alias("_in1"))
    both = left.join(right, list(keys), "full")
    verdict = F.when(F.col("_in0").isNull() | F.col("_in1").isNull(), "row missing").when(~F.col("_e0").eqNullSafe(F.col("_e1")), "mask differs").when(F.abs(F.col("_c0") - F.col("_c1")) > within, "box differs").otherwise("same")
    return both.select(*keys, verdict.alias("verdict"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merged_projects(left: DataFrame, right: DataFrame, left_name: str, right_name: str, video: str = "video_id", name: str = "name") -> DataFrame:
    """The videos of two projects under new ids, ordered by name without case. Merging a project with itself is an error."""
    if left_name == right_name:
        raise ValueError("a project can't be merged with itself")
    one = lambda df, p: df.withColumn("project", F.lit(p)).withColumn("new_id", new_video_id(F.lit(p), F.col(video)))
    return one(left, left_name).unionByName(one(right, right_name)).orderBy(F.lower(name), "new_id")


def new_video_id(project: Column, video: Column) -> Column:
    """The id of a video in a merged project: 12 hex digits of the SHA-256 of both names."""
    return F.substring(F.sha2(F.concat_ws("/", project, video.cast("string")), 256), 1, 12)


def united(tables: dict[str, DataFrame], video: str = "video_id") -> DataFrame:
    """Tables of several projects (windows, frames, labels) as one: project and new_id before their columns; a column that a table lacks is null."""
    out = None
    for project, table in tables.items():
        named = table.select(F.lit(project).alias("project"), new_video_id(F.lit(project), F.col(video)).alias("new_id"), *table.columns)
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How the distinct keys of two tables compare, one row: n_a, n_b, equal, a_in_b, and whether a's are the first of b's in their order.

    The keys of a are the first of b's if b has them all and none that a lacks comes before a's last.
    """
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    key = F.struct(*keys)
    out = both.agg(
        F.count_if(F.col("_a") == 1).alias("n_a"), F.count_if(F.col("_b") == 1).alias("n_b"), F.count_if(F.col("_a") > F.col("_b")).alias("_only_a"), F.count_if(F.col("_a") < F.col("_b")).alias("_only_b"),
        F.max(F.when(F.col("_a") == 1, key)).alias("_last"), F.min(F.when(F.col("_a") < F.col("_b"), key)).alias("_first"),
    )
    inside = F.col("_only_a") == 0
    return out.select("n_a", "n_b", (inside & (F.col("_only_b") == 0)).alias("equal"), inside.alias("a_in_b"), (inside & F.coalesce(F.col("_last") < F.col("_first"), F.lit(True))).alias("a_first"))


def stale_caches(videos: DataFrame, cache: DataFrame, keys: Sequence[str] = ("video_id", "signature")) -> DataFrame:
    """The videos to be computed again: no cache of the same signature that is newer than the source. videos: keys, changed_at; cache: keys, cached_at."""
    return videos.join(cache.select(*keys, "cached_at"), list(keys), "left").where("cached_at IS NULL OR cached_at < changed_at").select(*videos.columns)


def without_prompts(prompts: DataFrame, first: int | None = None, last: int | None = None, objects: Sequence[str] | None = None) -> DataFrame:
    """Prompts outside of a range of frames, or of other objects."""
    hit = in_range("frame_idx", first, last)
    return prompts.where(~(hit & F.col("object_id").isin(*objects)) if objects else ~hit)
