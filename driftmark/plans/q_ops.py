"""Queries on anchors, labelling time, coverage and throughput."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import report, stats
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_tracks import _r, r6

T = views.TIMING


def _t(spark, d):
    return views.timing(spark, d)


VIDEOS = "videos AS (SELECT c_custkey AS video_id, CAST(0 AS BIGINT) AS start, 40 + c_custkey % 50 AS n, 10 + c_custkey % 7 AS step FROM customer)"


def _videos(spark, d):
    c = views.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("video_id"), F.lit(0).cast("long").alias("start"), (F.lit(40) + F.col("c_custkey") % 50).alias("n"), (F.lit(10) + F.col("c_custkey") % 7).alias("step"))


GRID = f"{VIDEOS}, g AS (SELECT DISTINCT video_id, frame_idx FROM (SELECT video_id, unnest(range(start, n, step)) AS frame_idx FROM videos UNION ALL SELECT video_id, n - 1 FROM videos)), grid AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS place, frame_idx FROM g)"


@register("anchor_grid", f"WITH {GRID} SELECT video_id, place, frame_idx FROM grid")
def anchor_grid(spark, d):
    return report.anchor_grid(_videos(spark, d)).withColumn("place", F.col("place").cast("long"))


DONE = "done AS (SELECT DISTINCT o_custkey AS video_id, o_orderkey % 60 AS frame_idx FROM orders UNION SELECT o_custkey, CAST(0 AS BIGINT) FROM orders WHERE o_custkey % 3 = 0)"


@register("anchors_complete", f"""WITH {GRID}, {DONE}, j AS (SELECT g.*, d.video_id IS NOT NULL AS ok FROM grid g LEFT JOIN done d ON g.video_id = d.video_id AND g.frame_idx = d.frame_idx)
SELECT video_id, count(*) AS required, count(*) FILTER (ok) AS labelled, coalesce(min(place) FILTER (NOT ok), count(*)) AS first_open, count(*) FILTER (ok) = count(*) AS complete, count(*) FILTER (ok) > 0 AS started,
CAST(least(100, floor(100 * count(*) FILTER (ok) / count(*) + 0.5)) AS BIGINT) AS percent FROM j GROUP BY 1""")
def anchors_complete(spark, d):
    o = views.table(spark, d, "orders")
    marked = o.select(F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") % 60).alias("frame_idx"))
    asked = o.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("video_id"), F.lit(0).cast("long").alias("frame_idx"))
    return report.anchors_complete(report.anchor_grid(_videos(spark, d)), marked.unionByName(asked).distinct())


@register("sample_frames", f"""WITH {VIDEOS}, g AS (SELECT DISTINCT video_id, f FROM (SELECT video_id, unnest(range(0, n, 15)) AS f FROM videos UNION ALL SELECT video_id, n - 1 FROM videos))
SELECT video_id, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS frames FROM g GROUP BY 1""")
def sample_frames(spark, d):
    return _videos(spark, d).select("video_id", F.array_join(report.sample_frames(F.lit(0).cast("long"), F.col("n"), F.lit(15).cast("long")), ",").alias("frames"))


@register("nearby_frames", f"""WITH {VIDEOS}, c AS (SELECT video_id, f, min(i) AS i FROM (SELECT video_id, 12 AS frame, i, greatest(0, least(n - 1, 12 + k)) AS f FROM videos, (VALUES (0, 30), (1, -30), (2, 60), (3, -60)) AS t(i, k)) WHERE f <> frame GROUP BY 1, 2)
SELECT video_id, string_agg(CAST(f AS VARCHAR), ',' ORDER BY i) AS frames FROM c GROUP BY 1""")
def nearby_frames(spark, d):
    return _videos(spark, d).select("video_id", F.array_join(report.nearby_frames(F.lit(12).cast("long"), F.col("n"), 30), ",").alias("frames"))


@register("batch_ranges", f"WITH {VIDEOS} SELECT video_id, p AS first, least(p + 16, n - 1) AS last FROM (SELECT video_id, n, unnest(range(start, n, 17)) AS p FROM videos)")
def batch_ranges(spark, d):
    return _videos(spark, d).select("video_id", F.explode(report.ranges(F.col("start"), F.col("n") - 1, 17)).alias("r")).select("video_id", "r.first", "r.last")


ANCHORS = T + ", anchors AS (SELECT DISTINCT video_id, frame_idx FROM timing)"


def _anchors(spark, d):
    return _t(spark, d).select("video_id", "frame_idx").distinct()


@register("anchor_gaps", f"WITH {ANCHORS} SELECT video_id, frame_idx, row_number() OVER w AS number, round(frame_idx / 30, 6) AS time_s, frame_idx - lag(frame_idx) OVER w AS gap FROM anchors WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)")
def anchor_gaps(spark, d):
    return r6(report.anchor_gaps(_anchors(spark, d), 30))


@register("anchor_interval", f"WITH {ANCHORS}, g AS (SELECT video_id, frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS gap FROM anchors) SELECT video_id, median(gap) AS \"interval\" FROM g WHERE gap > 0 GROUP BY 1")
def anchor_interval(spark, d):
    return report.anchor_interval(_anchors(spark, d))


LABEL = T + """,
l AS (SELECT video_id, frame_idx, order_id, row_number() OVER (PARTITION BY video_id ORDER BY entered_ms NULLS LAST, frame_idx, order_id) AS number, (entered_ms - min(entered_ms) OVER (PARTITION BY video_id)) / 1000 AS start_s,
    (committed_ms - min(entered_ms) OVER (PARTITION BY video_id)) / 1000 AS commit_s, coalesce(duration_ms, committed_ms - entered_ms) / 1000 AS duration_s FROM timing WHERE coalesce(duration_ms, committed_ms - entered_ms) IS NOT NULL)"""


@register("labelling_rows", f"WITH {LABEL}, pc AS (SELECT video_id, frame_idx, CAST(sum(1 + order_id % 3) AS BIGINT) AS prompt_count FROM timing WHERE order_id % 5 > 0 GROUP BY 1, 2) SELECT video_id, frame_idx, order_id, coalesce(prompt_count, 0) AS prompt_count, number, round(start_s, 3) AS start_s, round(commit_s, 3) AS commit_s, round(duration_s, 3) AS duration_s, round(sum(duration_s) OVER (PARTITION BY video_id ORDER BY number ROWS UNBOUNDED PRECEDING), 3) AS cumulative_s FROM l LEFT JOIN pc USING (video_id, frame_idx)")
def labelling_rows(spark, d):
    prompts = _t(spark, d).where("order_id % 5 > 0").select("video_id", "frame_idx", (1 + F.col("order_id") % 3).alias("prompts"))
    return _r(report.labelling_rows(_t(spark, d), tie=["order_id"], prompts=prompts), start_s=3, commit_s=3, duration_s=3, cumulative_s=3)


@register("labelling_totals", f"WITH {T} SELECT video_id, min(entered_ms) AS first_ms, max(committed_ms) AS last_ms, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS frames, max(committed_ms) - min(entered_ms) AS wall_ms FROM timing GROUP BY 1")
def labelling_totals(spark, d):
    return report.labelling_totals(_t(spark, d))


@register("quick_clicks", f"WITH {LABEL} SELECT video_id, count(*) AS rows, count(*) FILTER (duration_s < 4) AS excluded, round(count(*) FILTER (duration_s < 4) / count(*), 6) AS excluded_share FROM l GROUP BY 1")
def quick_clicks(spark, d):
    return r6(report.without_clicks(report.labelling_rows(_t(spark, d), tie=["order_id"]))[1])


@register("labelling_summary", f"""WITH {LABEL} SELECT video_id, count(duration_s) AS n, round(avg(duration_s), 9) AS mean, round(CASE WHEN count(duration_s) = 1 THEN 0 ELSE stddev_samp(duration_s) END, 9) AS sd, round(quantile_cont(duration_s, 0.25), 9) AS q25, round(median(duration_s), 9) AS median,
round(quantile_cont(duration_s, 0.75), 9) AS q75, round(min(duration_s), 9) AS min, round(max(duration_s), 9) AS max FROM l WHERE duration_s IS NULL OR duration_s >= 4 GROUP BY 1 HAVING count(duration_s) > 0""")
def labelling_summary(spark, d):
    kept = report.without_clicks(report.labelling_rows(_t(spark, d), tie=["order_id"]))[0]
    return _r(stats.summary(kept, ["video_id"], "duration_s"), mean=9, sd=9, q25=9, median=9, q75=9, min=9, max=9)


SAVES = "saves AS (SELECT user_id % 20 AS video_id, date_trunc('hour', ts) AS updated_at, event_id AS frame_idx, length(props) AS bytes FROM events)"


def _saves(spark, d):
    e = views.table(spark, d, "events")
    return e.select((F.col("user_id") % 20).alias("video_id"), F.date_trunc("hour", "ts").alias("updated_at"), F.col("event_id").alias("frame_idx"), F.length("props").alias("bytes"))


BURSTS = SAVES + """,
b AS (SELECT video_id, updated_at, count(*) AS frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, avg(bytes) AS mean_bytes FROM saves GROUP BY 1, 2),
t AS (SELECT *, epoch(updated_at) - epoch(min(updated_at) OVER (PARTITION BY video_id)) AS elapsed_s, epoch(updated_at) - epoch(lag(updated_at) OVER w) AS gap_s, sum(frames) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative FROM b WINDOW w AS (PARTITION BY video_id ORDER BY updated_at))"""


@register("throughput", f"WITH {BURSTS} SELECT video_id, updated_at, frames, first_frame, last_frame, round(mean_bytes, 6) AS mean_bytes, elapsed_s, gap_s, CAST(cumulative AS BIGINT) AS cumulative, round(frames / nullif(gap_s, 0), 9) AS fps, round(cumulative / nullif(elapsed_s, 0), 9) AS fps_so_far FROM t")
def throughput(spark, d):
    return _r(report.throughput(_saves(spark, d)), mean_bytes=6, fps=9, fps_so_far=9)


@register("throughput_outliers", f"WITH {BURSTS}, q AS (SELECT quantile_cont(frames, 0.25) AS q25, median(frames) AS q50, quantile_cont(frames, 0.75) AS q75 FROM b) SELECT video_id, updated_at, frames, q25, q50, q75, frames < q25 - 1.5 * (q75 - q25) OR frames > q75 + 1.5 * (q75 - q25) AS outlier FROM b, q")
def throughput_outliers(spark, d):
    return stats.throughput_outliers(report.throughput(_saves(spark, d)).select("video_id", "updated_at", "frames"), "frames")


@register("coverage", f"""WITH {SAVES}, v AS (SELECT video_id, max(frame_idx) + 1 AS n FROM saves GROUP BY 1), s AS (SELECT video_id, n, unnest(range(0, (n - 1) // 1000 + 1)) AS bin FROM v), c AS (SELECT video_id, frame_idx // 1000 AS bin, count(DISTINCT frame_idx) AS frames FROM saves GROUP BY 1, 2)
SELECT s.video_id, s.bin, coalesce(frames, 0) AS frames, round(coalesce(frames, 0) / least(1000, n - s.bin * 1000), 6) AS share FROM s LEFT JOIN c ON s.video_id = c.video_id AND s.bin = c.bin""")
def coverage(spark, d):
    saves = _saves(spark, d)
    return r6(report.coverage(saves, saves.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))))


@register("video_summary", f"""WITH {SAVES}, {LABEL.strip()}, a AS (SELECT video_id, count(*) AS frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, CAST(epoch(max(updated_at)) - epoch(min(updated_at)) AS DOUBLE) AS save_s FROM saves GROUP BY 1),
b AS (SELECT video_id, count(duration_s) AS labelled, sum(duration_s) AS label_s, quantile_cont(duration_s, 0.25) AS q1, median(duration_s) AS q2, quantile_cont(duration_s, 0.75) AS q3 FROM l GROUP BY 1)
SELECT coalesce(a.video_id, b.video_id) AS video_id, frames, first_frame, last_frame, save_s, labelled, round(label_s, 3) AS label_s, round(q1, 9) AS label_q25, round(q2, 9) AS label_q50, round(q3, 9) AS label_q75, round(frames / nullif(save_s, 0), 9) AS saves_per_s, round(save_s / (frames / 30), 5) AS realtime_factor
FROM a FULL JOIN b ON a.video_id = b.video_id""")
def video_summary(spark, d):
    out = report.video_summary(_saves(spark, d), report.labelling_rows(_t(spark, d), tie=["order_id"]), 30)
    return _r(out, label_s=3, label_q25=9, label_q50=9, label_q75=9, saves_per_s=9, realtime_factor=5)


@register("gap_groups", f"""WITH {views.LABELLED}, r AS (SELECT value, (doc_id % 50) / 1000 AS gap FROM labelled), u AS (SELECT 'touching' AS gap_group, value FROM r WHERE gap <= 1e-12 UNION ALL SELECT 'apart', value FROM r WHERE gap > 1e-12 UNION ALL SELECT 'near', value FROM r WHERE gap < 0.02 UNION ALL SELECT 'far', value FROM r WHERE gap > 0.02)
SELECT gap_group, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM u GROUP BY 1""")
def gap_groups(spark, d):
    rows = views.labelled(spark, d).withColumn("gap", (F.col("doc_id") % 50) / 1000)
    return r6(stats.summary(report.gap_groups(rows, "gap", "value"), ["gap_group"], "value").select("gap_group", "n", "mean", "median"))


@register("merge_summaries", "SELECT c_custkey AS video_id, c_name AS name, CASE WHEN count(o_orderkey) = 0 THEN NULL ELSE round(max(o_totalprice), 2) END AS score FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def merge_summaries(spark, d):
    base = views.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    again = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.round(F.max("o_totalprice"), 2).alias("score"))
    return report.merge_summaries(base, again, "video_id")


@register("prompt_texts", f"WITH {T} SELECT video_id, frame_idx, CAST(sum([2, 1, 0, 0, 1, 0][CAST(order_id % 6 AS INT) + 1]) AS BIGINT) AS prompts FROM timing GROUP BY 1, 2")
def prompt_texts(spark, d):
    """Prompts kept as JSON: lists count their entries, other values that aren't empty count as one."""
    texts = F.array(*[F.lit(t) for t in ("[[1, 2], [3, 4]]", '{"x": 1}', "[]", "null", "7", "0")])
    return report.prompt_counts(_t(spark, d).withColumn("points", F.get(texts, (F.col("order_id") % 6).cast("int"))), "points", ["video_id", "frame_idx"])


@register("prompt_counts", f"WITH {T} SELECT video_id, CAST(sum(1 + frame_idx % 3) AS BIGINT) AS prompts FROM timing GROUP BY 1")
def prompt_counts(spark, d):
    prompts = _t(spark, d).withColumn("points", F.array_repeat(F.lit(1), (1 + F.col("frame_idx") % 3).cast("int")))
    return report.prompt_counts(prompts, "points", ["video_id"])


@register("long_metrics", f"WITH {T}, s AS (SELECT video_id, count(*) AS frames, max(frame_idx) AS last_frame FROM timing GROUP BY 1) SELECT video_id, 'frames' AS metric, CAST(frames AS VARCHAR) AS value FROM s UNION ALL SELECT video_id, 'last_frame', CAST(last_frame AS VARCHAR) FROM s")
def long_metrics(spark, d):
    return report.long_metrics(_t(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.max("frame_idx").alias("last_frame")), "video_id")


@register("wide_metrics", f"WITH {T} SELECT video_id, CAST(count(*) AS DOUBLE) AS frames, CAST(max(frame_idx) AS DOUBLE) AS last_frame FROM timing GROUP BY 1")
def wide_metrics(spark, d):
    return report.wide_metrics(long_metrics(spark, d), "video_id", ["frames", "last_frame"])


@register("run_stats", "SELECT count(*) AS samples, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS labelled FROM orders")
def run_stats(spark, d):
    return report.run_stats(views.table(spark, d, "orders").withColumn("reward", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))))


@register("newest_runs", "SELECT o_orderkey AS id, o_custkey AS project FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 25")
def newest_runs(spark, d):
    runs = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderstatus").alias("status"))
    return report.newest(runs, 25, status="F", project=None).drop("status")


@register("agreement", f"WITH {views.ETHOGRAM} SELECT \"group\", round(avg(CAST(cluster = CASE WHEN value > 50 THEN 'click' ELSE 'view' END AS DOUBLE)), 6) AS agreement FROM ethogram GROUP BY 1")
def agreement(spark, d):
    e = views.ethogram(spark, d).withColumn("guess", F.when(F.col("value") > 50, "click").otherwise("view"))
    return r6(report.agreement(e, ["group"], "guess", "cluster"))


@register("split_frames", f"WITH {views.TRACKS}, p AS (SELECT video_id, object_id, frame_idx, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY video_id, object_id) AS n FROM tracks WINDOW w AS (PARTITION BY video_id, object_id ORDER BY frame_idx)) SELECT video_id, object_id, frame_idx, CASE WHEN p < floor(n * 0.7) THEN 'train' WHEN p < floor(n * 0.7) + 5 THEN 'gap' ELSE 'eval' END AS split FROM p")
def split_frames(spark, d):
    return report.split_frames(views.tracks(spark, d), ["video_id", "object_id"], 0.7, 5).select("video_id", "object_id", "frame_idx", "split")


@register("project_overview", "SELECT c_custkey AS video_id, count(DISTINCT o_orderpriority) AS objects, count(o_orderkey) AS prompts, count(DISTINCT o_orderdate) AS anchors FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def project_overview(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    o = views.table(spark, d, "orders").withColumnRenamed("o_custkey", "video_id")
    return c.join(o, "video_id", "left").groupBy("video_id").agg(F.countDistinct("o_orderpriority").alias("objects"), F.count("o_orderkey").alias("prompts"), F.countDistinct("o_orderdate").alias("anchors"))


@register("object_counts", "SELECT k.frame_idx, count(DISTINCT l_linenumber) AS objects FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM orders))) AS frame_idx) k LEFT JOIN lineitem ON l_orderkey = k.frame_idx GROUP BY 1")
def object_counts(spark, d):
    top = views.table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("n"))
    spine = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame_idx"))
    counts = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame_idx")).agg(F.countDistinct("l_linenumber").alias("objects"))
    return spine.join(counts, "frame_idx", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))


ROWS = LABEL + """,
lr AS (SELECT l.video_id, l.frame_idx, l.order_id, duration_s, CASE WHEN order_id % 9 > 0 THEN (order_id % 50) / 1000 END AS gap, CASE WHEN order_id % 9 > 0 THEN (order_id % 50) / 1000 + (order_id % 7) / 100 END AS centre FROM l)"""
USER_SAVES = "saves AS (SELECT user_id AS video_id, date_trunc('hour', ts) AS updated_at, event_id AS frame_idx FROM events)"


def _metrics(spark, d):
    videos = views.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), (F.lit(4000) + F.col("c_custkey") % 50).alias("num_frames"), F.lit(30.0).alias("fps"))
    saves = views.table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.date_trunc("hour", "ts").alias("updated_at"), F.col("event_id").alias("frame_idx"))
    rows = report.labelling_rows(_t(spark, d), tie=["order_id"])
    gap = F.when(F.col("order_id") % 9 > 0, (F.col("order_id") % 50) / 1000)
    rows = rows.select("video_id", "duration_s", gap.alias("gap"), (gap + (F.col("order_id") % 7) / 100).alias("centre"))
    prompts = _t(spark, d).select("video_id", "frame_idx", (1 + F.col("frame_idx") % 3).alias("points"))
    return report.video_metrics(videos, saves, _anchors(spark, d), prompts, rows), rows, saves


def _parts(group: str, rule: str) -> str:
    return ", ".join((f"count(*) FILTER ({rule}) AS {group}_n", f"median(duration_s) FILTER ({rule}) AS {group}_median", f"avg(duration_s) FILTER ({rule}) AS {group}_mean", f"CASE WHEN count(*) FILTER ({rule}) = 1 THEN 0 ELSE stddev_samp(duration_s) FILTER ({rule}) END AS {group}_sd"))


RULES = (("touching", "gap <= 1e-12"), ("apart", "gap > 1e-12"), ("near", "gap < 0.02"), ("far", "gap > 0.02"))
RANK = lambda c, n: f"(SELECT video_id, CASE WHEN count(*) >= 2 THEN corr(a, b) END AS {n} FROM (SELECT video_id, rank() OVER (PARTITION BY video_id ORDER BY duration_s) + (count(*) OVER (PARTITION BY video_id, duration_s) - 1) / 2 AS a, rank() OVER (PARTITION BY video_id ORDER BY {c}) + (count(*) OVER (PARTITION BY video_id, {c}) - 1) / 2 AS b FROM lr WHERE duration_s IS NOT NULL AND {c} IS NOT NULL) GROUP BY 1)"
METRICS = f"""{USER_SAVES}, {ROWS.strip()},
v AS (SELECT c_custkey AS video_id, 4000 + c_custkey % 50 AS num_frames, 30.0::DOUBLE AS fps FROM customer),
sv AS (SELECT video_id, count(DISTINCT frame_idx) AS saved, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, min(updated_at) AS first_update, max(updated_at) AS last_update, CAST(epoch(max(updated_at)) - epoch(min(updated_at)) AS DOUBLE) AS elapsed_s FROM saves GROUP BY 1),
bu AS (SELECT video_id, n / nullif(epoch(updated_at) - epoch(lag(updated_at) OVER (PARTITION BY video_id ORDER BY updated_at)), 0) AS f FROM (SELECT video_id, updated_at, count(*) AS n FROM saves GROUP BY ALL)),
bq AS (SELECT video_id, quantile_cont(f, 0.25) AS burst_fps_q25, median(f) AS burst_fps_median, quantile_cont(f, 0.75) AS burst_fps_q75 FROM bu WHERE f IS NOT NULL GROUP BY 1),
bo AS (SELECT bu.video_id, count(*) FILTER (f < burst_fps_q25 - 1.5 * (burst_fps_q75 - burst_fps_q25) OR f > burst_fps_q75 + 1.5 * (burst_fps_q75 - burst_fps_q25)) AS burst_outliers FROM bu JOIN bq ON bu.video_id = bq.video_id GROUP BY 1),
an AS (SELECT DISTINCT video_id, frame_idx FROM timing), ac AS (SELECT video_id, count(*) AS anchors FROM an GROUP BY 1), ai AS (SELECT video_id, median(g) AS "interval" FROM (SELECT video_id, frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM an) WHERE g > 0 GROUP BY 1),
pr AS (SELECT video_id, count(DISTINCT frame_idx) AS prompted_frames, CAST(sum(1 + frame_idx % 3) AS BIGINT) AS prompts FROM timing GROUP BY 1),
ti AS (SELECT video_id, count(duration_s) AS timed, sum(duration_s) AS label_s, quantile_cont(duration_s, 0.25) AS label_q25, median(duration_s) AS label_median, quantile_cont(duration_s, 0.75) AS label_q75, avg(duration_s) AS label_mean, max(duration_s) AS label_max,
    count(gap) AS gaps, quantile_cont(gap, 0.25) AS gap_q25, median(gap) AS gap_median, quantile_cont(gap, 0.75) AS gap_q75, median(centre) AS centre_median FROM lr GROUP BY 1),
gg AS (SELECT video_id, {", ".join(_parts(*r) for r in RULES)} FROM lr WHERE gap IS NOT NULL AND duration_s IS NOT NULL GROUP BY 1),
mt AS (SELECT v.*, coalesce(saved, 0) AS saved, first_frame, last_frame, first_update, last_update, elapsed_s, burst_fps_q25, burst_fps_median, burst_fps_q75, coalesce(burst_outliers, 0) AS burst_outliers, coalesce(anchors, 0) AS anchors, "interval", coalesce(prompted_frames, 0) AS prompted_frames, coalesce(prompts, 0) AS prompts,
    coalesce(timed, 0) AS timed, label_s, label_q25, label_median, label_q75, label_mean, label_max, coalesce(gaps, 0) AS gaps, gap_q25, gap_median, gap_q75, centre_median, rho_gap, rho_centre,
    {", ".join(f"coalesce({g}_n, 0) AS {g}_n, {g}_median, {g}_mean, {g}_sd" for g, _ in RULES)}, coalesce(last_frame - first_frame + 1, 0) AS span, num_frames / fps AS video_s, coalesce(saved, 0) / num_frames AS coverage, coalesce(saved, 0) / nullif(coalesce(last_frame - first_frame + 1, 0), 0) AS span_coverage,
    num_frames / nullif(coalesce(anchors, 0), 0) AS frames_per_anchor, coalesce(saved, 0) / nullif(coalesce(anchors, 0), 0) AS saved_per_anchor, coalesce(anchors, 0) / num_frames AS anchor_share, saved / nullif(elapsed_s, 0) AS saves_per_s, saved / nullif(elapsed_s, 0) / fps AS realtime_factor,
    nullif(elapsed_s, 0) / ((last_frame - first_frame + 1) / fps) AS s_per_video_s
    FROM v LEFT JOIN sv USING (video_id) LEFT JOIN bq USING (video_id) LEFT JOIN bo USING (video_id) LEFT JOIN ac USING (video_id) LEFT JOIN ai USING (video_id) LEFT JOIN pr USING (video_id) LEFT JOIN ti USING (video_id) LEFT JOIN {RANK("gap", "rho_gap")} USING (video_id) LEFT JOIN {RANK("centre", "rho_centre")} USING (video_id) LEFT JOIN gg USING (video_id))"""
NUMBERS = [
    "elapsed_s", "burst_fps_q25", "burst_fps_median", "burst_fps_q75", "interval", "label_s", "label_q25", "label_median", "label_q75", "label_mean", "label_max", "gap_q25", "gap_median", "gap_q75", "centre_median", "rho_gap", "rho_centre",
    *[f"{g}_{c}" for g, _ in RULES for c in ("median", "mean", "sd")], "video_s", "coverage", "span_coverage", "frames_per_anchor", "saved_per_anchor", "anchor_share", "saves_per_s", "realtime_factor", "s_per_video_s",
]


@register("video_metrics", f"WITH {METRICS} SELECT * REPLACE (" + ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in NUMBERS) + ") FROM mt")
def video_metrics(spark, d):
    return r6(_metrics(spark, d)[0])


SUMMARY_SQL = "count(v) AS n, round(avg(v), 6) AS mean, round(CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS sd, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(min(v), 6) AS min, round(max(v), 6) AS max"


@register("across_videos", f"WITH {METRICS}, x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM mt" for m in report.ACROSS) + f" UNION ALL SELECT 'pooled_label_s', duration_s FROM lr UNION ALL SELECT 'pooled_gap', gap FROM lr UNION ALL SELECT 'pooled_burst_fps', f FROM bu " + " ".join(f"UNION ALL SELECT 'pooled_label_s_{g}', duration_s FROM lr WHERE {rule} AND duration_s >= 4" for g, rule in RULES) + f" UNION ALL SELECT unnest(['timed_raw', 'clicks_excluded', 'timed_analysed', 'click_share']), unnest([n, q, n - q, q / n]) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (duration_s < 4) AS q FROM lr GROUP BY video_id)) SELECT metric, {SUMMARY_SQL} FROM x WHERE v IS NOT NULL GROUP BY 1")
def across_videos(spark, d):
    metrics, rows, saves = _metrics(spark, d)
    bursts = report.throughput(saves.withColumn("bytes", F.lit(0)))
    return r6(report.across_videos(metrics, {"pooled_label_s": rows.select("duration_s"), "pooled_gap": rows.select("gap"), "pooled_burst_fps": bursts.select("fps")}, rows=rows, nan=True))
