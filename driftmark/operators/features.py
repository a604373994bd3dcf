"""Features of sliding windows: 12 of one object, 9 of a pair, and the 33 columns of both objects and the pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions.scalars import wrap_pi
from driftmark.operators import windows

OBJECT_FEATURES = ("energy", "speed_mean", "speed_std", "speed_max", "angular_velocity_mean", "angular_velocity_std", "frac_time_moving", "area_mean", "area_std", "area_range", "area_slope", "mean_eccentricity")
PAIR_FEATURES = ("approach_retreat_rate", "parallel_movement_score", "chase_metric", "chase_lag", "frac_close_proximity", "mean_relative_heading", "min_distance_mean", "min_distance_std", "overlap_frac_mean")
#: Extracted, but left out of analyses.
NOT_ANALYSED = ("overlap_frac_mean",)


def object_features(frames: DataFrame, keys: Sequence[str], chunk: int = 90, stride: int = 30, moving: float = 0.001) -> DataFrame:
    """The 12 features of each window of each key; all null with fewer than 3 seen frames or no step.

    frames: keys, frame_idx, cx, cy, area, orientation, eccentricity on a dense axis, null where not seen. A window
    doesn't own the changes into its first frame. The slope is over the number of the frame among those with an area.
    """
    changes = windows.steps(frames, keys, ["cx", "cy", "orientation"])
    inside = windows.sliding(changes, keys, chunk, stride)
    own = F.col("frame_idx") > F.col("start_frame")
    dx, dy = F.when(own, F.col("d_cx")), F.when(own, F.col("d_cy"))
    turn = F.when(own, F.abs(wrap_pi(F.col("d_orientation"))))
    number = F.sum(F.when(F.col("area").isNotNull(), 1).otherwise(0)).over(W.partitionBy(*keys, "start_frame").orderBy("frame_idx"))
    rows = inside.select(*keys, "start_frame", "cx", "cy", "area", "eccentricity", dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("step"), turn.alias("turn"), number.cast("double").alias("number"))
    out = rows.groupBy(*keys, "start_frame").agg(
        F.count(F.when(F.col("cx").isNotNull() & F.col("cy").isNotNull(), 1)).alias("_seen"), F.count("step").alias("_steps"),
        F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("energy"), F.avg("step").alias("speed_mean"), F.stddev_pop("step").alias("speed_std"), F.max("step").alias("speed_max"),
        F.avg("turn").alias("angular_velocity_mean"), F.stddev_pop("turn").alias("angular_velocity_std"), F.avg((F.col("step") > moving).cast("double")).alias("frac_time_moving"),
        F.avg("area").alias("area_mean"), F.stddev_pop("area").alias("area_std"), (F.max("area") - F.min("area")).alias("area_range"),
        F.when(F.count("area") >= 2, F.coalesce(F.regr_slope(F.col("area"), F.when(F.col("area").isNotNull(), F.col("number"))), F.lit(0.0))).alias("area_slope"), F.avg("eccentricity").alias("mean_eccentricity"),
    )
    enough = (F.col("_seen") >= 3) & (F.col("_steps") >= 1)
    return out.select(*keys, "start_frame", *[F.when(enough, F.col(c)).alias(c) for c in OBJECT_FEATURES])


def pair_features(frames: DataFrame, keys: Sequence[str], chunk: int = 90, stride: int = 30, close: float = 0.05, max_lag: int = 10) -> DataFrame:
    """The 9 features of each window of a pair; all null with fewer than 3 distances.

    frames: keys, frame_idx, ax, ay, bx, by, distance, contour_distance, overlap, combined, heading_ab, heading_ba. chase_lag > 0 means that a trails b.
    """
    changes = windows.steps(frames, keys, ["ax", "ay", "bx", "by", "distance"])
    inside = windows.sliding(changes, keys, chunk, stride)
    own = F.col("frame_idx") > F.col("start_frame")
    names = ["ax", "ay", "bx", "by", "distance"]
    rows = inside.select("*", *[F.when(own, F.col(f"d_{c}")).alias(f"w_{c}") for c in names])
    va, vb = F.hypot("w_ax", "w_ay"), F.hypot("w_bx", "w_by")
    dot = F.col("w_ax") * F.col("w_bx") + F.col("w_ay") * F.col("w_by")
    cosine = F.when(va * vb > 1e-8, dot / (va * vb))
    joint = F.col("ax").isNotNull() & F.col("ay").isNotNull() & F.col("bx").isNotNull() & F.col("by").isNotNull()
    heading = (F.col("heading_ab") + F.col("heading_ba")) / 2
    by = [*keys, "start_frame"]
    base = rows.groupBy(*by).agg(
        F.count("distance").alias("_n"), F.count(F.when(joint, 1)).alias("_joint"),
        F.avg("w_distance").alias("approach_retreat_rate"), F.avg(cosine).alias("_cosine"), F.count(F.when(va.isNotNull() & vb.isNotNull(), 1)).alias("_both"),
        F.avg((F.col("distance") < close).cast("double")).alias("frac_close_proximity"), F.avg(heading).alias("mean_relative_heading"),
        F.avg("contour_distance").alias("min_distance_mean"), F.stddev_pop("contour_distance").alias("min_distance_std"),
        F.avg(F.when(F.col("combined") > 0, F.col("overlap") / F.col("combined"))).alias("overlap_frac_mean"),
    )
    # Speeds of all steps of a window, unknown ones 0, less their mean; then products at each lag.
    speeds = rows.where(own).select(*by, "frame_idx", F.coalesce(va, F.lit(0.0)).alias("sa"), F.coalesce(vb, F.lit(0.0)).alias("sb"))
    lists = speeds.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("frame_idx", "sa", "sb"))).alias("s"))  # at most `chunk` of them
    lists = lists.select(*by, F.transform("s", lambda x: x["sa"]).alias("a"), F.transform("s", lambda x: x["sb"]).alias("b"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x) / F.size(c)
    lists = lists.withColumn("_ma", mean("a")).withColumn("_mb", mean("b"))
    lists = lists.select(*by, F.transform("a", lambda x: x - F.col("_ma")).alias("a"), F.transform("b", lambda x: x - F.col("_mb")).alias("b"))
    dot_of = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda t, v: t + v)
    lists = lists.withColumn("_norm", F.sqrt(dot_of(F.col("a"), F.col("a")) * dot_of(F.col("b"), F.col("b"))))
    n = F.size("a")
    at = lambda c, k: F.slice(c, k + 1, F.greatest(n - k, F.lit(0)))
    lags = []
    for k in range(-max_lag, max_lag + 1):
        left, right = (at("a", k), F.slice("b", 1, F.greatest(n - k, F.lit(0)))) if k >= 0 else (F.slice("a", 1, F.greatest(n + k, F.lit(0))), at("b", -k))
        lags.append(F.struct((dot_of(left, right) / F.col("_norm")).alias("c"), F.lit(-k).alias("o")))
    lists = lists.where("_norm > 1e-12").select(*by, F.array_max(F.array(*lags)).alias("_best"))
    out = base.join(lists, by, "left")
    enough, chased = F.col("_n") >= 3, F.col("_joint") >= 2 * max_lag + 2
    return out.select(
        *by, F.when(enough, F.col("approach_retreat_rate")).alias("approach_retreat_rate"),
        F.when(enough & (F.col("_joint") >= 3) & (F.col("_both") >= 2), F.col("_cosine")).alias("parallel_movement_score"),
        F.when(enough & chased, F.col("_best")["c"]).alias("chase_metric"), F.when(enough & chased, (-F.col("_best")["o"]).cast("double")).alias("chase_lag"),
        *[F.when(enough, F.col(c)).alias(c) for c in PAIR_FEATURES[4:]],
    )


def window_features(a: DataFrame, b: DataFrame, pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 33 columns of each window: a_ and b_ object features and the pair's, joined on the window's key."""
    by = [*keys, "start_frame"]
    left = a.select(*by, *[F.col(c).alias(f"a_{c}") for c in OBJECT_FEATURES])
    right = b.select(*by, *[F.col(c).alias(f"b_{c}") for c in OBJECT_FEATURES])
    return left.join(right, by, "full").join(pair.select(*by, *PAIR_FEATURES), by, "full")


def analysed(windows_: DataFrame) -> DataFrame:
    """Without the columns that analyses leave out."""
    return windows_.drop(*NOT_ANALYSED)


def side_columns(columns: Sequence[str], side: str) -> list[str]:
    """The feature columns of one side: `a`, `b` or `pair`."""
    return [c for c in columns if (c in PAIR_FEATURES if side == "pair" else c.startswith(f"{side}_"))]


def focal_rows(windows_: DataFrame, keys: Sequence[str], identity: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Each pair row as two focal rows: the focal object's features without a prefix, the pair's with the headings and lag as they are.

    identity: pairs of columns that say of a and of b the same (id, role, housing, name). Of the focal object b they are exchanged, so that the first of
    each is always the focal object's.
    """
    said = {"a": [F.col(x).alias(x) for pair in identity for x in pair], "b": [F.col(y).alias(x) for a, b in identity for x, y in ((a, b), (b, a))]}
    rows = [F.struct(F.lit(s).alias("focal_side"), *said[s], *[F.col(f"{s}_{c}").alias(c) for c in OBJECT_FEATURES], *[F.col(c) for c in PAIR_FEATURES if c not in NOT_ANALYSED]) for s in ("a", "b")]
    return windows_.select(*keys, "start_frame", F.explode(F.array(*rows)).alias("r")).select(*keys, "start_frame", "r.*")


def focal_a(windows_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows of videos with one animal: the a side alone, without a prefix."""
    own = side_columns(windows_.columns, "a")
    return windows_.select(*keys, "start_frame", F.lit("a").alias("focal_side"), *[F.col(c).alias(c.removeprefix("a_")) for c in own])


def missing_profile(table: DataFrame, columns: Sequence[str], worst: int = 5) -> DataFrame:
    """The columns with most missing values: feature, missing, share."""
    counts = table.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot(["_n"], list(columns), "feature", "missing")
    return long.select("feature", "missing", F.try_divide(F.col("missing"), F.col("_n")).alias("share")).orderBy(F.desc("missing"), "feature").limit(worst)


def proximity(frames: DataFrame, video: str, distance: str, size: str, cutoffs: Sequence[float] = (0.02, 0.05, 0.1, 0.15, 0.2), least: int = 10) -> DataFrame:
    """Share of a video's seen frames in which the distance over the diagonal is below each cutoff; videos with fewer than `least` such frames are left out."""
    norm = F.col(distance) / F.greatest(F.col(size), F.lit(1.0))
    cells = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.avg((norm < c).cast("double")).alias("fraction")) for c in cutoffs])
    out = frames.where(F.col(distance).isNotNull()).groupBy(video).agg(F.count(F.lit(1)).alias("frames"), cells.alias("c")).where(F.col("frames") >= least)
    return out.select(video, "frames", F.explode("c").alias("c")).select(video, "frames", "c.cutoff", "c.fraction")
