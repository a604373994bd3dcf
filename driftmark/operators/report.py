"""Operational reports: anchors, labelling time, coverage, throughput."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions.scalars import micros, ratio


def anchor_grid(videos: DataFrame, video: str = "video_id", start: str = "start", stop: str = "n", step: str = "step") -> DataFrame:
    """Anchor frames: every step-th from start, and the last frame."""
    grid = F.array_union(F.sequence(F.col(start), F.col(stop) - 1, F.col(step)), F.array(F.col(stop) - 1))
    return videos.where(F.col(stop) > F.col(start)).select(video, F.posexplode(grid).alias("place", "frame_idx"))


def sample_frames(start: Column, frames: Column, interval: Column, last: bool = True) -> Column:
    """Every interval-th frame from start, and the last one if asked; empty without frames."""
    first, end = F.greatest(start, F.lit(0)), frames - 1
    grid = F.when(first <= end, F.sequence(first, F.greatest(first, end), F.greatest(interval, F.lit(1)))).otherwise(F.array(F.least(first, end)))
    plan = F.array_union(grid, F.array(end)) if last else grid
    return F.when(frames <= 0, F.array().cast("array<long>")).otherwise(plan.cast("array<long>"))


def nearby_frames(frame: Column, frames: Column, offset: int) -> Column:
    """Frames one and two offsets after and before, kept inside the video, without the frame itself and repeats, in that order."""
    raw = F.array(*[frame + k for k in (offset, -offset, 2 * offset, -2 * offset)])
    inside = F.transform(raw, lambda f: F.greatest(F.lit(0), F.least(frames - 1, f)))
    return F.filter(F.array_distinct(inside), lambda f: f != frame)


def ranges(start: Column, stop: Column, size: int) -> Column:
    """Consecutive ranges of `size` frames up to and with stop, as structs first, last."""
    return F.transform(F.sequence(start, stop, F.lit(size).cast("long")), lambda p: F.struct(p.alias("first"), F.least(p + size - 1, stop).alias("last")))


def anchors_complete(required: DataFrame, done: DataFrame, video: str = "video_id") -> DataFrame:
    """For each video the required anchors, those done, the place of the first that isn't (their number if all are), complete, started and percent."""
    marked = required.join(done.select(video, "frame_idx", F.lit(True).alias("_done")).distinct(), [video, "frame_idx"], "left")
    out = marked.groupBy(video).agg(F.count(F.lit(1)).alias("required"), F.count("_done").alias("labelled"), F.min(F.when(F.col("_done").isNull(), F.col("place"))).alias("first_open"))
    out = out.withColumn("first_open", F.coalesce("first_open", F.col("required")).cast("long"))
    percent = F.least(F.lit(100), F.floor(100 * F.col("labelled") / F.col("required") + 0.5))
    return out.withColumn("complete", F.col("labelled") == F.col("required")).withColumn("started", F.col("labelled") > 0).withColumn("percent", percent.cast("long"))


def anchor_gaps(anchors: DataFrame, fps: float, video: str = "video_id") -> DataFrame:
    """Number, time and gap from the previous anchor of each anchor."""
    w = W.partitionBy(video).orderBy("frame_idx")
    return anchors.select(video, "frame_idx", F.row_number().over(w).cast("long").alias("number"), (F.col("frame_idx") / fps).alias("time_s"), (F.col("frame_idx") - F.lag("frame_idx").over(w)).alias("gap"))


def anchor_interval(anchors: DataFrame, video: str = "video_id") -> DataFrame:
    """Median of the positive gaps between a video's anchors."""
    gap = F.col("frame_idx") - F.lag("frame_idx").over(W.partitionBy(video).orderBy("frame_idx"))
    return anchors.select(video, gap.alias("gap")).where("gap > 0").groupBy(video).agg(F.percentile("gap", 0.5).alias("interval"))


def labelling_rows(timing: DataFrame, video: str = "video_id", tie: Sequence[str] = (), prompts: DataFrame | None = None) -> DataFrame:
    """Labelled frames in the order of being entered: number, seconds from the first entered to entering and committing, duration and cumulative duration.

    An unknown duration is committed less entered; a frame whose duration stays unknown is left out before the others are numbered. prompts (video, frame_idx, prompts) adds
    prompt_count, 0 for a frame without.
    """
    timing = timing.where(F.coalesce(F.col("duration_ms"), F.col("committed_ms") - F.col("entered_ms")).isNotNull())
    w = W.partitionBy(video).orderBy(F.col("entered_ms").asc_nulls_last(), "frame_idx", *tie)
    first = F.min("entered_ms").over(W.partitionBy(video))
    took = F.coalesce(F.col("duration_ms"), F.col("committed_ms") - F.col("entered_ms")) / 1000
    rows = timing.select(video, "frame_idx", *tie, F.row_number().over(w).cast("long").alias("number"), ((F.col("entered_ms") - first) / 1000).alias("start_s"), ((F.col("committed_ms") - first) / 1000).alias("commit_s"), took.alias("duration_s"))
    rows = rows.withColumn("cumulative_s", F.sum("duration_s").over(W.partitionBy(video).orderBy("number").rowsBetween(W.unboundedPreceding, 0)))
    if prompts is None:
        return rows
    counts = prompts.groupBy(video, "frame_idx").agg(F.sum("prompts").cast("long").alias("prompt_count"))
    return rows.join(counts, [video, "frame_idx"], "left").withColumn("prompt_count", F.coalesce("prompt_count", F.lit(0).cast("long")))


def labelling_totals(timing: DataFrame, video: str = "video_id") -> DataFrame:
    """First entered, last committed, wall time and sum of durations of each video."""
    out = timing.groupBy(video).agg(F.min("entered_ms").alias("first_ms"), F.max("committed_ms").alias("last_ms"), F.sum("duration_ms").alias("total_ms"), F.count(F.lit(1)).alias("frames"))
    return out.withColumn("wall_ms", F.col("last_ms") - F.col("first_ms"))


def without_clicks(rows: DataFrame, least: float = 4.0, video: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """Rows of unknown duration or of `least` seconds or more, and how many others each video had."""
    quick = F.coalesce(F.col("duration_s") < least, F.lit(False))
    counts = rows.groupBy(video).agg(F.count(F.lit(1)).alias("rows"), F.count_if(quick).alias("excluded"))
    return rows.where(~quick), counts.withColumn("excluded_share", ratio(F.col("excluded"), F.col("rows")))


def throughput(saves: DataFrame, video: str = "video_id") -> DataFrame:
    """Bursts of frames saved at one time: count, first and last frame, mean bytes, elapsed seconds, cumulative frames, and frames per second since the burst before and since the first."""
    bursts = saves.groupBy(video, "updated_at").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.avg("bytes").alias("mean_bytes"))
    w = W.partitionBy(video).orderBy("updated_at")
    secs = lambda a, b: (micros(a) - micros(b)) / 1_000_000
    at = F.col("updated_at")
    out = bursts.withColumn("elapsed_s", secs(at, F.min("updated_at").over(W.partitionBy(video)))).withColumn("gap_s", secs(at, F.lag("updated_at").over(w)))
    out = out.withColumn("cumulative", F.sum("frames").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("fps", ratio(F.col("frames"), F.col("gap_s"))).withColumn("fps_so_far", ratio(F.col("cumulative"), F.col("elapsed_s")))


def coverage(frames: DataFrame, videos: DataFrame, size: int = 1000, video: str = "video_id") -> DataFrame:
    """Distinct frames in each interval of `size` frames of a video, empty ones included, and their share of the interval, the last of which may be short. videos: video, n."""
    bins = videos.where("n > 0").select(video, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("bin"))
    counts = frames.groupBy(video, F.floor(F.col("frame_idx") / size).alias("bin")).agg(F.countDistinct("frame_idx").alias("frames"))
    out = bins.join(counts, [video, "bin"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    length = F.least(F.lit(size), F.col("n") - F.col("bin") * size)
    return out.select(video, "bin", "frames", (F.col("frames") / length).alias("share"))


def video_summary(frames: DataFrame, rows: DataFrame, fps: float, video: str = "video_id") -> DataFrame:
    """Of each video: frames, span, seconds and realtime factor of its saves, and quartiles of its labelling durations; unknown where a source has no row."""
    saved = frames.groupBy(video).agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), ((micros(F.max("updated_at")) - micros(F.min("updated_at"))) / 1_000_000).alias("save_s"))
    q = rows.groupBy(video).agg(F.count("duration_s").alias("labelled"), F.sum("duration_s").alias("label_s"), F.percentile("duration_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    labels = q.select(video, "labelled", "label_s", F.col("q")[0].alias("label_q25"), F.col("q")[1].alias("label_q50"), F.col("q")[2].alias("label_q75"))
    out = saved.join(labels, video, "full")
    return out.withColumn("saves_per_s", ratio(F.col("frames"), F.col("save_s"))).withColumn("realtime_factor", ratio(F.col("save_s"), F.col("frames") / fps))


def gap_groups(rows: DataFrame, gap: str, duration: str, near: float = 0.02, keys: Sequence[str] = ()) -> DataFrame:
    """Durations by how near two boxes are: touching or apart, near or far; a gap of exactly the border is neither near nor far."""
    g = F.col(gap)
    named = F.array_compact(F.array(F.when(g <= 1e-12, "touching"), F.when(g > 1e-12, "apart"), F.when(g < near, "near"), F.when(g > near, "far")))
    return rows.where(g.isNotNull() & F.col(duration).isNotNull()).select(*keys, F.explode(named).alias("gap_group"), duration)


def merge_summaries(base: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """The columns of base; those that `again` also has come from it, even where they are null."""
    new = [c for c in again.columns if c != key]
    kept = [c for c in base.columns if c != key and c not in new]
    return base.select(key, *kept).join(again, key, "left")


def prompt_counts(prompts: DataFrame, points: str, by: Sequence[str]) -> DataFrame:
    """Points placed by key: the entries of a list; any other value that isn't empty counts as one. Values may be arrays, JSON texts, or of any other type."""
    kind, value = dict(prompts.dtypes)[points], F.col(points)
    if kind.startswith("array"):
        one = F.greatest(F.size(value), F.lit(0))
    elif kind == "string":
        nothing = F.trim(value).isin("", "null", "false", "0", "0.0", "{}", '""')
        one = F.coalesce(F.json_array_length(value), F.when(~nothing, 1))
    else:
        one = F.when(value.isNotNull() & ~F.lower(value.cast("string")).isin("0", "0.0", "-0.0", "false"), 1)
    return prompts.groupBy(*by).agg(F.sum(F.coalesce(one, F.lit(0))).cast("long").alias("prompts"))


def long_metrics(summary: DataFrame, key: str) -> DataFrame:
    """A summary as rows key, metric, value (text)."""
    values = [c for c in summary.columns if c != key]
    return summary.select(key, *[F.col(c).cast("string").alias(c) for c in values]).unpivot([key], values, "metric", "value")


def wide_metrics(long: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Rows key, metric, value as one row for each key, numbers where the text is one."""
    return long.groupBy(key).pivot("metric", list(metrics)).agg(F.first(F.col("value").try_cast("double")))


def run_stats(samples: DataFrame) -> DataFrame:
    """Samples and how many of them have a reward."""
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.count("reward").alias("labelled"))


def newest(samples: DataFrame, limit: int, **equal: object) -> DataFrame:
    """The newest samples that match, `limit` (kept in 1 to 1000) at most."""
    out = samples
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out.orderBy(F.desc("id")).limit(min(max(int(limit), 1), 1000))


def agreement(table: DataFrame, keys: Sequence[str], predicted: str, truth: str) -> DataFrame:
    """Share of rows predicted right by key; 0 without rows of both."""
    right = F.avg((F.col(predicted) == F.col(truth)).cast("double"))
    return table.groupBy(*keys).agg(F.coalesce(right, F.lit(0.0)).alias("agreement"))


def split_frames(frames: DataFrame, keys: Sequence[str], train: float, gap: int) -> DataFrame:
    """Marks frames in order as train, gap or eval: the first share of them, `gap` more, and the rest. The share is taken as the decimal it is written as: 0.7 of 90 frames are 63."""
    w = W.partitionBy(*keys)
    place, n = F.row_number().over(w.orderBy("frame_idx")) - 1, F.count(F.lit(1)).over(w)
    edge = F.floor(n * F.lit(Decimal(str(train))))
    return frames.withColumn("split", F.when(place < edge, "train").when(place < edge + gap, "gap").otherwise("eval"))


GAP_GROUPS = ("touching", "apart", "near", "far")


def _quartiles(name: str, value: str) -> list[Column]:
    return [F.percentile(value, p).alias(f"{name}_{q}") for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]


def video_metrics(videos: DataFrame, frames: DataFrame, anchors: DataFrame, prompts: DataFrame, rows: DataFrame, video: str = "video_id") -> DataFrame:
    """All metrics of each video, a row for each: length, coverage, anchors, prompts, labelling times, gaps between boxes, saving and its bursts.

    videos: video, num_frames, fps; frames (saved): video, frame_idx, updated_at; anchors: video, frame_idx; prompts: video, frame_idx, points (a number); rows (labelled
    anchors): video, duration_s, gap, centre. What a source doesn't have is 0 if it is a count, else null; so is a quotient by 0.
    """
    from driftmark.operators import stats

    saved = frames.groupBy(video).agg(F.countDistinct("frame_idx").alias("saved"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.min("updated_at").alias("first_update"), F.max("updated_at").alias("last_update"), ((micros(F.max("updated_at")) - micros(F.min("updated_at"))) / 1_000_000).alias("elapsed_s"))
    bursts = throughput(frames.withColumn("bytes", F.lit(0)), video).where("fps IS NOT NULL").select(video, "fps")
    quart = bursts.groupBy(video).agg(*_quartiles("burst_fps", "fps"))
    reach = 1.5 * (F.col("burst_fps_q75") - F.col("burst_fps_q25"))
    odd = bursts.join(quart, video).groupBy(video).agg(F.count_if((F.col("fps") < F.col("burst_fps_q25") - reach) | (F.col("fps") > F.col("burst_fps_q75") + reach)).alias("burst_outliers"))
    marks = anchors.select(video, "frame_idx").distinct()
    own = marks.groupBy(video).agg(F.count(F.lit(1)).alias("anchors"))
    asked = prompts.groupBy(video).agg(F.countDistinct("frame_idx").alias("prompted_frames"), F.sum("points").cast("long").alias("prompts"))
    timed = rows.groupBy(video).agg(
        F.count("duration_s").alias("timed"), F.sum("duration_s").alias("label_s"), *_quartiles("label", "duration_s"), F.avg("duration_s").alias("label_mean"), F.max("duration_s").alias("label_max"),
        F.count("gap").alias("gaps"), *_quartiles("gap", "gap"), F.percentile("centre", 0.5).alias("centre_median"),
    )
    rank = lambda c, n: stats.spearman(rows, [video], "duration_s", c).where("n >= 2").select(video, F.col("rho").alias(n))
    grouped = gap_groups(rows, "gap", "duration_s", keys=[video])
    parts = stats.summary(grouped, [video, "gap_group"], "duration_s").groupBy(video).pivot("gap_group", list(GAP_GROUPS)).agg(F.first("n").alias("n"), F.first("median").alias("median"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    out = videos
    for part in (saved, quart, odd, own, anchor_interval(marks, video), asked, timed, rank("gap", "rho_gap"), rank("centre", "rho_centre"), parts):
        out = out.join(part, video, "left")
    zero = ["saved", "burst_outliers", "anchors", "prompted_frames", "prompts", "timed", "gaps", *[f"{g}_n" for g in GAP_GROUPS]]
    out = out.na.fill(0, zero).withColumn("span", F.coalesce(F.col("last_frame") - F.col("first_frame") + 1, F.lit(0)))
    c = F.col
    return (
        out.withColumn("video_s", ratio(c("num_frames"), c("fps"))).withColumn("coverage", ratio(c("saved"), c("num_frames"))).withColumn("span_coverage", ratio(c("saved"), c("span")))
        .withColumn("frames_per_anchor", ratio(c("num_frames"), c("anchors"))).withColumn("saved_per_anchor", ratio(c("saved"), c("anchors"))).withColumn("anchor_share", ratio(c("anchors"), c("num_frames")))
        .withColumn("saves_per_s", ratio(c("saved"), c("elapsed_s"))).withColumn("realtime_factor", ratio(c("saves_per_s"), c("fps"))).withColumn("s_per_video_s", ratio(F.nullif(c("elapsed_s"), F.lit(0.0)), c("span") / c("fps")))
    )


#: The metrics that are summarised across videos.
ACROSS = (
    "num_frames", "saved", "anchors", "frames_per_anchor", "saved_per_anchor", "coverage", "label_median", "gap_median", "centre_median", "rho_gap", "rho_centre", "touching_median", "apart_median",
    "near_median", "far_median", "saves_per_s", "burst_fps_q25", "burst_fps_median", "burst_fps_q75", "s_per_video_s",
)


def across_videos(metrics: DataFrame, pooled: dict[str, DataFrame], video: str = "video_id", rows: DataFrame | None = None, least: float = 4.0, nan: bool = False) -> DataFrame:
    """Summaries of the metrics across videos, and of pooled values (one column each) under their names: metric, n, mean, sd, quartiles, min, max.

    rows (labelled anchors: video, duration_s, gap) adds the durations by how near the boxes are, and by video the anchors timed, those of less than `least`
    seconds, the others and the share left out. The durations are those of the others. With `nan`, NaN (a correlation of constant values) counts as `stats.summary` says.
    """
    from driftmark.operators import stats

    long = metrics.select(video, *[F.col(m).cast("double").alias(m) for m in ACROSS]).unpivot([video], list(ACROSS), "metric", "value").select("metric", "value")
    for name, values in pooled.items():
        long = long.unionByName(values.select(F.lit(name).alias("metric"), F.col(values.columns[0]).cast("double").alias("value")))
    if rows is not None:
        kept, clicks = without_clicks(rows, least, video)
        grouped = gap_groups(kept, "gap", "duration_s").select(F.concat(F.lit("pooled_label_s_"), "gap_group").alias("metric"), F.col("duration_s").cast("double").alias("value"))
        counts = clicks.select(video, *[c.cast("double").alias(n) for n, c in (("timed_raw", F.col("rows")), ("clicks_excluded", F.col("excluded")), ("timed_analysed", F.col("rows") - F.col("excluded")), ("click_share", F.col("excluded_share")))])
        long = long.unionByName(grouped).unionByName(counts.unpivot([video], counts.columns[1:], "metric", "value").select("metric", "value"))
    return stats.summary(long, ["metric"], "value", nan)


def first_existing(candidates: DataFrame, existing: DataFrame, keys: Sequence[str], path: str, order: Column) -> DataFrame:
    """Of each key the first candidate path that exists, null where none does."""
    known = candidates.withColumn("_order", order).join(existing.select(path).distinct().withColumn("_there", F.lit(True)), path, "left")
    return known.groupBy(*keys).agg(F.min_by(F.when(F.col("_there"), F.col(path)), F.when(F.col("_there"), F.col("_order"))).alias(path))
