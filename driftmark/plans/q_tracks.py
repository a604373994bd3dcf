"""Queries on tracks and label sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.scalars import diagonal, fold_heading
from driftmark.operators import features, locomotion, transitions, windows
from driftmark.plans import views
from driftmark.plans.base import oracle_sql, register

KEYS = ["video_id", "object_id"]
CHUNK, STRIDE, LAG = 30, 10, 5


def _r(df, /, **digits):
    """Rounds the named columns."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def r6(df):
    return _r(df, **{c: 6 for c, t in df.dtypes if t == "double"})


@register("sliding_windows", f"WITH {views.WINDOWED} SELECT video_id, object_id, start_frame, count(*) AS frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM windowed GROUP BY ALL")
def sliding_windows(spark, d):
    w = windows.sliding(views.tracks(spark, d), KEYS, CHUNK, STRIDE)
    return w.groupBy(*KEYS, "start_frame").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


@register("path_lengths", f"WITH {views.STEPS} SELECT video_id, object_id, round(coalesce(sum(step), 0), 6) AS path FROM stepped GROUP BY ALL")
def path_lengths(spark, d):
    return r6(locomotion.path_lengths(views.tracks(spark, d)))


LOCO = (
    views.WINDOWED
    + """,
loco AS (
    SELECT video_id, object_id, start_frame, CASE WHEN count(CASE WHEN cx IS NOT NULL AND cy IS NOT NULL THEN 1 END) = 30 THEN coalesce(sum(CASE WHEN frame_idx > start_frame THEN step END), 0) END AS distance
    FROM windowed GROUP BY ALL
)"""
)


@register("locomotion_windows", f"WITH {LOCO} SELECT video_id, object_id, start_frame, round(distance, 6) AS distance FROM loco")
def locomotion_windows(spark, d):
    return r6(locomotion.locomotion(views.tracks(spark, d), CHUNK, STRIDE))


@register("locomotion_uneven", f"""WITH {views.STEPS}, w AS (
    SELECT s.*, w.start_frame FROM stepped s JOIN (SELECT DISTINCT video_id, object_id, unnest(range(0, len - 24, 10)) AS start_frame FROM stepped WHERE len >= 25) w
    ON s.video_id = w.video_id AND s.object_id = w.object_id AND s.frame_idx >= w.start_frame AND s.frame_idx < w.start_frame + 25)
SELECT video_id, object_id, start_frame, round(CASE WHEN count(CASE WHEN cx IS NOT NULL AND cy IS NOT NULL THEN 1 END) = 25 THEN coalesce(sum(CASE WHEN frame_idx > start_frame THEN step END), 0) END, 6) AS distance FROM w GROUP BY ALL""")
def locomotion_uneven(spark, d):
    return r6(locomotion.locomotion(views.tracks(spark, d), 25, 10))


@register("locomotion_pooled", f"""WITH {LOCO}, n AS (SELECT *, distance / 800 AS norm FROM loco WHERE distance IS NOT NULL),
r AS (SELECT *, (cume_dist() OVER (PARTITION BY video_id, object_id ORDER BY distance) + cume_dist() OVER (PARTITION BY video_id, object_id ORDER BY norm)) / 2 AS q FROM n)
SELECT object_id, count(distance) AS n, count(DISTINCT video_id) AS videos, round(avg(distance), 6) AS mean_abs, round(avg(norm), 6) AS mean_norm, round(avg(q), 6) AS mean_rank FROM r GROUP BY 1""")
def locomotion_pooled(spark, d):
    chunks = locomotion.locomotion(views.tracks(spark, d), CHUNK, STRIDE)
    return r6(locomotion.pooled(chunks, "object_id", "video_id", "distance", diagonal(F.lit(640), F.lit(480))))


@register("locomotion_snapshot", f"""WITH {LOCO} SELECT object_id, count(distance) AS n, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std,
round(quantile_cont(distance, 0.05), 6) AS p05, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.95), 6) AS p95 FROM loco WHERE distance IS NOT NULL GROUP BY 1""")
def locomotion_snapshot(spark, d):
    return r6(locomotion.snapshot(locomotion.locomotion(views.tracks(spark, d), CHUNK, STRIDE), ["object_id"], "distance"))


@register("locomotion_by_video", f"""WITH {LOCO} SELECT video_id, object_id, count(distance) AS chunks, round(avg(distance), 6) AS mean_distance, round(avg(distance / 800), 6) AS mean_distance_norm FROM loco GROUP BY 1, 2""")
def locomotion_by_video(spark, d):
    chunks = locomotion.locomotion(views.tracks(spark, d), CHUNK, STRIDE).withColumns({"width": F.lit(640.0), "height": F.lit(480.0)})
    out = locomotion.normalised(chunks).groupBy(*KEYS)
    return r6(out.agg(F.count("distance").alias("chunks"), F.avg("distance").alias("mean_distance"), F.avg("distance_norm").alias("mean_distance_norm")))


@register("quantile_ranks", f"WITH {LOCO} SELECT video_id, object_id, start_frame, round(cume_dist() OVER (PARTITION BY video_id, object_id ORDER BY round(distance, 6)), 6) AS quantile FROM loco WHERE distance IS NOT NULL")
def quantile_ranks(spark, d):
    chunks = r6(locomotion.locomotion(views.tracks(spark, d), CHUNK, STRIDE))
    return r6(locomotion.quantile_ranks(chunks, KEYS, "distance").drop("distance"))


OBJECT = (
    views.WINDOWED
    + """,
own AS (
    SELECT *, CASE WHEN frame_idx > start_frame THEN dx END AS wdx, CASE WHEN frame_idx > start_frame THEN dy END AS wdy, CASE WHEN frame_idx > start_frame THEN step END AS wstep,
        CASE WHEN frame_idx > start_frame THEN abs(turn + pi() - 2 * pi() * floor((turn + pi()) / (2 * pi())) - pi()) END AS wturn,
        CASE WHEN area IS NOT NULL THEN sum(CASE WHEN area IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, object_id, start_frame ORDER BY frame_idx) END AS number FROM windowed
),
objects AS (
    SELECT video_id, object_id, start_frame, count(CASE WHEN cx IS NOT NULL AND cy IS NOT NULL THEN 1 END) >= 3 AND count(wstep) >= 1 AS enough,
        sum(wdx * wdx + wdy * wdy) AS energy, avg(wstep) AS speed_mean, stddev_pop(wstep) AS speed_std, max(wstep) AS speed_max, avg(wturn) AS angular_velocity_mean, stddev_pop(wturn) AS angular_velocity_std,
        avg(CASE WHEN wstep IS NOT NULL THEN CAST(wstep > 5 AS DOUBLE) END) AS frac_time_moving, avg(area) AS area_mean, stddev_pop(area) AS area_std, max(area) - min(area) AS area_range,
        CASE WHEN count(area) >= 2 THEN regr_slope(area, number) END AS area_slope, avg(eccentricity) AS mean_eccentricity
    FROM own GROUP BY 1, 2, 3
)"""
)


@register("object_features", f"WITH {OBJECT} SELECT video_id, object_id, start_frame, " + ", ".join(f"round(CASE WHEN enough THEN {c} END, 5) AS {c}" for c in features.OBJECT_FEATURES) + " FROM objects")
def object_features(spark, d):
    out = features.object_features(views.tracks(spark, d), KEYS, CHUNK, STRIDE, moving=5)
    return _r(out, **{c: 5 for c in features.OBJECT_FEATURES})


def pair_frames(spark, d):
    """Both objects of a video by frame, in units of the frame's diagonal, with derived distances."""
    t = views.tracks(spark, d)
    side = lambda s: t.where(F.col("object_id") == s).select("video_id", "frame_idx", (F.col("cx") / 800).alias(f"{s}x"), (F.col("cy") / 800).alias(f"{s}y"), F.col("area").alias(f"{s}_area"), F.col("orientation").alias(f"{s}_turn"))
    both = side("a").join(side("b"), ["video_id", "frame_idx"])
    toward = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    return both.select(
        "video_id", "frame_idx", "ax", "ay", "bx", "by", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("distance"),
        F.greatest(F.lit(0.0), F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) - 0.01).alias("contour_distance"),
        F.abs(F.col("a_area") - F.col("b_area")).alias("overlap"), (F.col("a_area") + F.col("b_area")).alias("combined"),
        fold_heading(toward - F.col("a_turn")).alias("heading_ab"), fold_heading(toward + F.pi() - F.col("b_turn")).alias("heading_ba"),
    )


def _fold(x):
    turn = f"(({x}) - 2 * pi() * floor(({x}) / (2 * pi())))"
    return f"least({turn}, 2 * pi() - {turn})"


PAIRS = (
    views.TRACKS
    + f""",
joint AS (
    SELECT a.video_id, a.frame_idx, a.cx / 800 AS ax, a.cy / 800 AS ay, b.cx / 800 AS bx, b.cy / 800 AS by_, a.area AS a_area, b.area AS b_area, a.orientation AS ta, b.orientation AS tb
    FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.object_id = 'a' AND b.object_id = 'b'
),
frames AS (
    SELECT video_id, frame_idx, ax, ay, bx, by_, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS distance,
        CASE WHEN bx IS NOT NULL AND ax IS NOT NULL THEN greatest(0, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) - 0.01) ELSE 0 END AS contour_distance, abs(a_area - b_area) AS overlap, a_area + b_area AS combined,
        {_fold("atan2(by_ - ay, bx - ax) - ta")} AS heading_ab, {_fold("atan2(by_ - ay, bx - ax) + pi() - tb")} AS heading_ba FROM joint
),
changed AS (
    SELECT *, ax - lag(ax) OVER o AS dax, ay - lag(ay) OVER o AS day, bx - lag(bx) OVER o AS dbx, by_ - lag(by_) OVER o AS dby, distance - lag(distance) OVER o AS dd, max(frame_idx) OVER (PARTITION BY video_id) + 1 AS len
    FROM frames WINDOW o AS (PARTITION BY video_id ORDER BY frame_idx)
),
win AS (
    SELECT c.*, w.start_frame, c.frame_idx > w.start_frame AS own FROM changed c JOIN (SELECT DISTINCT video_id, unnest(range(0, len - 29, 10)) AS start_frame FROM changed WHERE len >= 30) w
    ON c.video_id = w.video_id AND c.frame_idx >= w.start_frame AND c.frame_idx < w.start_frame + 30
),
v AS (SELECT *, sqrt(dax ** 2 + day ** 2) AS va, sqrt(dbx ** 2 + dby ** 2) AS vb FROM win),
base AS (
    SELECT video_id, start_frame, count(distance) >= 3 AS enough, count(CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN 1 END) AS joint_frames, avg(CASE WHEN own THEN dd END) AS approach_retreat_rate,
        avg(CASE WHEN own AND va * vb > 1e-8 THEN (dax * dbx + day * dby) / (va * vb) END) AS cosine, count(CASE WHEN own AND va IS NOT NULL AND vb IS NOT NULL THEN 1 END) AS both_steps,
        avg(CASE WHEN distance IS NOT NULL THEN CAST(distance < 0.05 AS DOUBLE) END) AS frac_close_proximity, avg((heading_ab + heading_ba) / 2) AS mean_relative_heading,
        avg(contour_distance) AS min_distance_mean, stddev_pop(contour_distance) AS min_distance_std, avg(CASE WHEN combined > 0 THEN overlap / combined END) AS overlap_frac_mean
    FROM v GROUP BY 1, 2
),
speeds AS (SELECT video_id, start_frame, frame_idx, coalesce(va, 0) AS sa, coalesce(vb, 0) AS sb FROM v WHERE own),
centred AS (SELECT video_id, start_frame, frame_idx, sa - avg(sa) OVER w AS sa, sb - avg(sb) OVER w AS sb FROM speeds WINDOW w AS (PARTITION BY video_id, start_frame)),
norms AS (SELECT video_id, start_frame, sqrt(sum(sa * sa) * sum(sb * sb)) AS norm FROM centred GROUP BY 1, 2),
lagged AS (
    SELECT a.video_id, a.start_frame, a.frame_idx - b.frame_idx AS lag, sum(a.sa * b.sb) AS dot FROM centred a JOIN centred b ON a.video_id = b.video_id AND a.start_frame = b.start_frame AND a.frame_idx - b.frame_idx BETWEEN -5 AND 5 GROUP BY 1, 2, 3
),
chased AS (SELECT l.video_id, l.start_frame, max(dot / norm) AS c FROM lagged l JOIN norms n ON l.video_id = n.video_id AND l.start_frame = n.start_frame WHERE norm > 1e-12 GROUP BY 1, 2)"""
)


PAIR_ROWS = """SELECT b.video_id, b.start_frame, round(CASE WHEN enough THEN approach_retreat_rate END, 5) AS approach_retreat_rate,
round(CASE WHEN enough AND joint_frames >= 3 AND both_steps >= 2 THEN cosine END, 5) AS parallel_movement_score, round(CASE WHEN enough AND joint_frames >= 12 THEN c END, 5) AS chase_metric,
round(CASE WHEN enough THEN frac_close_proximity END, 5) AS frac_close_proximity, round(CASE WHEN enough THEN mean_relative_heading END, 5) AS mean_relative_heading,
round(CASE WHEN enough THEN min_distance_mean END, 5) AS min_distance_mean, round(CASE WHEN enough THEN min_distance_std END, 5) AS min_distance_std, round(CASE WHEN enough THEN overlap_frac_mean END, 5) AS overlap_frac_mean
FROM base b LEFT JOIN chased c ON b.video_id = c.video_id AND b.start_frame = c.start_frame"""


@register("pair_features", f"WITH {PAIRS} {PAIR_ROWS}")
def pair_features(spark, d):
    out = features.pair_features(pair_frames(spark, d), ["video_id"], CHUNK, STRIDE, max_lag=LAG).drop("chase_lag")
    return _r(out, **{c: 5 for c in features.PAIR_FEATURES if c != "chase_lag"})


LAG_ROWS = """SELECT b.video_id, b.start_frame, CAST(CASE WHEN enough AND joint_frames >= 12 THEN arg_min(lag, struct_pack(a := -round(dot / norm, 9), l := lag)) END AS DOUBLE) AS chase_lag
FROM base b LEFT JOIN norms n ON b.video_id = n.video_id AND b.start_frame = n.start_frame AND norm > 1e-12 LEFT JOIN lagged l ON l.video_id = n.video_id AND l.start_frame = n.start_frame GROUP BY b.video_id, b.start_frame, enough, joint_frames"""


@register("chase_lag", f"WITH {PAIRS} {LAG_ROWS}")
def chase_lag(spark, d):
    return features.pair_features(pair_frames(spark, d), ["video_id"], CHUNK, STRIDE, max_lag=LAG).select("video_id", "start_frame", "chase_lag")


def all_features(spark, d):
    t = views.tracks(spark, d)
    side = lambda s: features.object_features(t.where(F.col("object_id") == s).drop("object_id"), ["video_id"], CHUNK, STRIDE, moving=5)
    return features.window_features(side("a"), side("b"), features.pair_features(pair_frames(spark, d), ["video_id"], CHUNK, STRIDE, max_lag=LAG), ["video_id"])


SIDES = ", ".join(f"round(CASE WHEN {s}.enough THEN {s}.{c} END, 4) AS {s}_{c}" for s in "ab" for c in features.OBJECT_FEATURES)


@register("window_features", f"""WITH {OBJECT}, {"joint AS" + PAIRS.split("joint AS", 1)[1]}, pairs AS ({PAIR_ROWS}), lags AS ({LAG_ROWS})
SELECT coalesce(a.video_id, b.video_id, p.video_id) AS video_id, coalesce(a.start_frame, b.start_frame, p.start_frame) AS start_frame, {SIDES}, p.* EXCLUDE (video_id, start_frame), l.chase_lag
FROM (SELECT * FROM objects WHERE object_id = 'a') a FULL JOIN (SELECT * FROM objects WHERE object_id = 'b') b ON a.video_id = b.video_id AND a.start_frame = b.start_frame
FULL JOIN pairs p ON coalesce(a.video_id, b.video_id) = p.video_id AND coalesce(a.start_frame, b.start_frame) = p.start_frame
LEFT JOIN lags l ON l.video_id = p.video_id AND l.start_frame = p.start_frame""")
def window_features(spark, d):
    sides = {f"{s}_{c}": 4 for s in "ab" for c in features.OBJECT_FEATURES}
    return _r(all_features(spark, d), **sides, **{c: 5 for c in features.PAIR_FEATURES if c != "chase_lag"})


_SIDE = lambda s, own, other: f"""SELECT {s}.video_id, {s}.start_frame, '{s}' AS focal_side, 'm' || (2 * {s}.video_id + {own}) AS mouse_a, 'm' || (2 * {s}.video_id + {other}) AS mouse_b, CASE WHEN (2 * {s}.video_id + {own}) % 3 = 0 THEN 'SH' ELSE 'GH' END AS housing_a, CASE WHEN (2 * {s}.video_id + {other}) % 3 = 0 THEN 'SH' ELSE 'GH' END AS housing_b, round(CASE WHEN enough THEN energy END, 4) AS energy FROM objects {s} WHERE object_id = '{s}'"""


@register("focal_identities", f"WITH {OBJECT} {_SIDE('a', 0, 1)} UNION ALL {_SIDE('b', 1, 0)}")
def focal_identities(spark, d):
    """Focal rows with the identity and housing of the focal and of the other animal; rows of a side without windows are left out."""
    t = views.tracks(spark, d)
    side = lambda s: features.object_features(t.where(F.col("object_id") == s).drop("object_id"), ["video_id"], CHUNK, STRIDE, moving=5)
    pair = features.pair_features(pair_frames(spark, d), ["video_id"], CHUNK, STRIDE, max_lag=LAG)
    windows_ = features.window_features(side("a").withColumn("_s", F.lit(True)), side("b"), pair, ["video_id"])
    for i, s in enumerate("ab"):
        number = 2 * F.col("video_id") + i
        windows_ = windows_.withColumn(f"mouse_{s}", F.concat(F.lit("m"), number)).withColumn(f"housing_{s}", F.when(number % 3 == 0, "SH").otherwise("GH"))
    rows = features.focal_rows(windows_, ["video_id"], [("mouse_a", "mouse_b"), ("housing_a", "housing_b")])
    there = side("a").withColumn("focal_side", F.lit("a")).unionByName(side("b").withColumn("focal_side", F.lit("b"))).select("video_id", "start_frame", "focal_side")
    return _r(rows.join(there, ["video_id", "start_frame", "focal_side"], "left_semi").select("video_id", "start_frame", "focal_side", "mouse_a", "mouse_b", "housing_a", "housing_b", "energy"), energy=4)


@register("focal_rows", f"""WITH {OBJECT} SELECT object_id AS focal_side, count(*) AS n, round(avg(CASE WHEN enough THEN energy END), 4) AS energy, round(avg(CASE WHEN enough THEN speed_max END), 4) AS speed_max FROM objects GROUP BY 1""")
def focal_rows(spark, d):
    t = views.tracks(spark, d)
    side = lambda s: features.object_features(t.where(F.col("object_id") == s).drop("object_id"), ["video_id"], CHUNK, STRIDE, moving=5)
    pair = features.pair_features(pair_frames(spark, d), ["video_id"], CHUNK, STRIDE, max_lag=LAG)
    rows = features.focal_rows(features.window_features(side("a"), side("b"), pair, ["video_id"]), ["video_id"])
    counts = side("a").withColumn("focal_side", F.lit("a")).unionByName(side("b").withColumn("focal_side", F.lit("b"))).groupBy("focal_side").agg(F.count(F.lit(1)).alias("n"))
    means = rows.groupBy("focal_side").agg(F.avg("energy").alias("energy"), F.avg("speed_max").alias("speed_max"))
    return _r(counts.join(means, "focal_side"), energy=4, speed_max=4)


@register("missing_profile", f"""WITH {OBJECT}, n AS (SELECT count(*) AS n, """ + ", ".join(f"count(CASE WHEN NOT enough OR {c} IS NULL THEN 1 END) AS {c}" for c in features.OBJECT_FEATURES) + """ FROM objects),
u AS (UNPIVOT n ON COLUMNS(* EXCLUDE (n)) INTO NAME feature VALUE missing) SELECT feature, missing, round(missing / n, 6) AS share FROM u ORDER BY missing DESC, feature LIMIT 5""")
def missing_profile(spark, d):
    return r6(features.missing_profile(features.object_features(views.tracks(spark, d), KEYS, CHUNK, STRIDE, moving=5), features.OBJECT_FEATURES))


@register("proximity", f"""WITH {PAIRS}, c AS (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.2])::DOUBLE AS cutoff)
SELECT video_id, count(*) AS frames, cutoff, round(avg(CAST(distance < cutoff AS DOUBLE)), 6) AS fraction FROM frames, c WHERE distance IS NOT NULL GROUP BY video_id, cutoff HAVING count(*) >= 10""")
def proximity(spark, d):
    return r6(features.proximity(pair_frames(spark, d).withColumn("size", F.lit(1.0)), "video_id", "distance", "size"))


@register("proximity_by_group", f"""WITH {PAIRS}, c AS (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.2])::DOUBLE AS cutoff),
f AS (SELECT video_id, cutoff, avg(CAST(distance < cutoff AS DOUBLE)) AS fraction FROM frames, c WHERE distance IS NOT NULL GROUP BY video_id, cutoff HAVING count(*) >= 10)
SELECT video_id % 3 AS grp, cutoff, count(*) AS videos, round(avg(fraction), 6) AS mean_fraction FROM f GROUP BY 1, 2""")
def proximity_by_group(spark, d):
    shares = features.proximity(pair_frames(spark, d).withColumn("size", F.lit(1.0)), "video_id", "distance", "size")
    return r6(shares.groupBy((F.col("video_id") % 3).alias("grp"), "cutoff").agg(F.count(F.lit(1)).alias("videos"), F.avg("fraction").alias("mean_fraction")))


E_ = views.ETHOGRAM
STEPS_ = E_ + """, steps AS (SELECT * FROM (SELECT video_id, "group", cluster AS from_label, lead(cluster) OVER (PARTITION BY video_id ORDER BY start_frame) AS to_label FROM ethogram) WHERE to_label IS NOT NULL)"""


@register("sequences", f"WITH {E_} SELECT video_id, count(*) AS n_windows, string_agg(cluster, '>' ORDER BY start_frame) AS labels, arg_min(cluster, start_frame) AS first_label FROM ethogram GROUP BY 1")
def sequences(spark, d):
    return transitions.sequences(views.ethogram(spark, d)).withColumn("labels", F.array_join("labels", ">")).withColumn("n_windows", F.col("n_windows").cast("long"))


@register("transition_counts", f"WITH {STEPS_} SELECT from_label, to_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY from_label), 6) AS p FROM steps GROUP BY 1, 2")
def transition_counts(spark, d):
    return r6(transitions.matrix(transitions.pairs(views.ethogram(spark, d), ["video_id"])))


@register("transitions_without_loops", f"WITH {STEPS_} SELECT \"group\", from_label, to_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY \"group\", from_label), 6) AS p FROM steps WHERE from_label <> to_label GROUP BY 1, 2, 3")
def transitions_without_loops(spark, d):
    return r6(transitions.matrix(transitions.pairs(views.ethogram(spark, d), ["video_id"], keep=["group"]), ["group"], loops=False))


@register("group_matrices", f"""WITH {STEPS_}, m AS (SELECT "group", from_label, to_label, count(*) AS n FROM steps WHERE "group" <> 'g3' GROUP BY 1, 2, 3)
SELECT m."group", from_label, to_label, n, round(n / sum(n) OVER (PARTITION BY m."group", from_label), 6) AS p, n_videos, n_windows, CAST(sum(n) OVER (PARTITION BY m."group") AS BIGINT) AS n_transitions
FROM m JOIN (SELECT "group", count(DISTINCT video_id) AS n_videos, count(*) AS n_windows FROM ethogram GROUP BY 1) s ON m."group" = s."group" """)
def group_matrices(spark, d):
    return r6(transitions.group_matrices(views.ethogram(spark, d), "group", exclude=["g3"]))


@register("transition_differences", f"""WITH {STEPS_}, c AS (SELECT "group" AS g, from_label, to_label, count(*) AS n FROM steps GROUP BY 1, 2, 3), m AS (SELECT *, n / sum(n) OVER (PARTITION BY g, from_label) AS p FROM c),
k AS (SELECT x.g AS group_a, y.g AS group_b FROM (SELECT DISTINCT g FROM m) x JOIN (SELECT DISTINCT g FROM m) y ON x.g < y.g),
u AS (SELECT group_a, group_b, from_label, to_label, p FROM k JOIN m ON g = group_a UNION ALL SELECT group_a, group_b, from_label, to_label, -p FROM k JOIN m ON g = group_b),
d AS (SELECT group_a, group_b, from_label, to_label, sum(p) AS diff FROM u GROUP BY 1, 2, 3, 4)
SELECT group_a, group_b, from_label, to_label, round(diff, 6) AS diff, round(max(abs(diff)) OVER (PARTITION BY group_a, group_b), 6) AS largest FROM d""")
def transition_differences(spark, d):
    m = transitions.matrix(transitions.pairs(views.ethogram(spark, d), ["video_id"], keep=["group"]), ["group"])
    return r6(transitions.differences(m, "group"))


@register("composition", f"""WITH {E_}, s AS (SELECT * FROM (SELECT DISTINCT "group" FROM ethogram), (SELECT DISTINCT cluster FROM ethogram)), n AS (SELECT "group", cluster, count(*) AS n FROM ethogram GROUP BY 1, 2)
SELECT s."group", s.cluster, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s."group"), 6) AS share, round(sum(coalesce(n, 0)) OVER (PARTITION BY s."group") / sum(coalesce(n, 0)) OVER (), 6) AS group_share
FROM s LEFT JOIN n ON s."group" = n."group" AND s.cluster = n.cluster""")
def composition(spark, d):
    return r6(transitions.composition(views.ethogram(spark, d), "group"))


@register("label_shares_by_video", f"""WITH {E_} SELECT video_id, "group", cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY video_id), 6) AS share FROM ethogram GROUP BY 1, 2, 3""")
def label_shares_by_video(spark, d):
    return r6(transitions.shares_by_video(views.ethogram(spark, d), keep=["group"]))


@register("label_summary", f"""WITH {E_} SELECT cluster, count(*) AS n, round(avg(value), 6) AS mean_value, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ethogram GROUP BY 1""")
def label_summary(spark, d):
    return r6(transitions.label_summary(views.ethogram(spark, d), ["value"]))


@register("label_group_pivot", f"""WITH {E_} SELECT cluster, count(*) FILTER ("group" = 'g0') AS g0, count(*) FILTER ("group" = 'g1') AS g1, count(*) FILTER ("group" = 'g2') AS g2, count(*) FILTER ("group" = 'g3') AS g3 FROM ethogram GROUP BY 1""")
def label_group_pivot(spark, d):
    return views.ethogram(spark, d).groupBy("cluster").pivot("group", ["g0", "g1", "g2", "g3"]).agg(F.count(F.lit(1))).na.fill(0)


@register("centroid_spine", f"""WITH {views.TRACKS}, n AS (SELECT video_id, max(frame_idx) AS last FROM tracks GROUP BY 1), s AS (SELECT n.video_id, o.object_id, unnest(range(0, last + 1)) AS frame_idx FROM n, (SELECT DISTINCT object_id FROM tracks) o)
SELECT s.video_id, s.object_id, count(*) AS frames, count(cx) AS seen, round(sum(cx), 4) AS sum_cx FROM s LEFT JOIN tracks t ON s.video_id = t.video_id AND s.object_id = t.object_id AND s.frame_idx = t.frame_idx GROUP BY 1, 2""")
def centroid_spine(spark, d):
    t = views.tracks(spark, d)
    axes = t.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("stop")).withColumn("start", F.lit(0).cast("long"))
    spine = windows.frame_spine(axes, ["video_id"], "start", "stop").join(t.select("object_id").distinct())
    dense = spine.join(t.select(*KEYS, "frame_idx", "cx"), [*KEYS, "frame_idx"], "left")
    return _r(dense.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("frames"), F.count("cx").alias("seen"), F.sum("cx").alias("sum_cx")), sum_cx=4)


_WINDOWS = oracle_sql()["window_features"]


@register("analysed_features", f"SELECT * EXCLUDE ({', '.join(features.NOT_ANALYSED)}) FROM ({_WINDOWS})")
def analysed_features(spark, d):
    return features.analysed(window_features(spark, d))


@register("focal_a", f"SELECT video_id, start_frame, 'a' AS focal_side, {', '.join(f'a_{c} AS {c}' for c in features.OBJECT_FEATURES)} FROM ({_WINDOWS})")
def focal_a(spark, d):
    return features.focal_a(window_features(spark, d), ["video_id"])
