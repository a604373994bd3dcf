"""Queries on mask runs, boxes and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import masks
from driftmark.plans import views
from driftmark.plans.base import oracle_sql, register
from driftmark.plans.q_tracks import _r, r6
from driftmark.sources import masks as stored

KEYS = ["frame_idx", "object_id"]


def _runs(spark, d):
    return masks.merged(views.runs(spark, d))


@register("mask_runs", f"WITH {views.PIXELS} SELECT frame_idx, object_id, count(*) AS area, min(x) AS x0, max(x) AS x1 FROM pixels GROUP BY 1, 2")
def mask_runs(spark, d):
    return _runs(spark, d).groupBy(*KEYS).agg(F.sum("len").alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"))


MOMENTS = views.PIXELS + """,
m AS (SELECT frame_idx, object_id, CAST(count(*) AS DOUBLE) AS area, avg(x) AS cx, avg(y) AS cy, avg(x * x) - avg(x) ** 2 AS vxx, avg(y * y) - avg(y) ** 2 AS vyy, avg(x * y) - avg(x) * avg(y) AS vxy FROM pixels GROUP BY 1, 2),
s AS (SELECT *, sqrt(greatest((vxx + vyy) / 2 + sqrt(((vxx - vyy) / 2) ** 2 + vxy ** 2), 0)) AS major, sqrt(greatest((vxx + vyy) / 2 - sqrt(((vxx - vyy) / 2) ** 2 + vxy ** 2), 0)) AS minor FROM m)"""


@register("mask_shapes", f"WITH {MOMENTS} SELECT frame_idx, object_id, area, round(cx, 5) AS cx, round(cy, 5) AS cy, round(major, 4) AS major, round(CASE WHEN minor < 1e-5 THEN 0 ELSE minor END, 4) AS minor, "
          "CASE WHEN major - minor > 1e-3 AND abs(vxy) > 1e-6 THEN round(atan2(2 * vxy, vxx - vyy) / 2, 4) END AS orientation, round(CASE WHEN major < 1e-5 THEN 0 WHEN minor < 1e-5 THEN 1 ELSE sqrt(greatest(1 - (minor / major) ** 2, 0)) END, 3) AS eccentricity FROM s")
def mask_shapes(spark, d):
    """The orientation is compared where the axes differ and don't lie along the frame's, as it is noise or one of two ends elsewhere."""
    out = masks.shapes(_runs(spark, d))
    skew = (F.col("major") - F.col("minor")) * F.abs(F.sin(2 * F.col("orientation"))) * (F.col("major") + F.col("minor")) / 2  # the covariance
    out = out.withColumn("orientation", F.when((F.col("major") - F.col("minor") > 1e-3) & (skew > 1e-6), F.round("orientation", 4)))
    out = out.withColumn("eccentricity", F.round(F.when(F.col("major") < 1e-5, 0.0).when(F.col("minor") < 1e-5, 1.0).otherwise(F.col("eccentricity")), 3))
    return _r(out.withColumn("minor", F.when(F.col("minor") < 1e-5, 0.0).otherwise(F.col("minor"))), cx=5, cy=5, major=4, minor=4)


@register("mask_boxes", f"WITH {views.PIXELS} SELECT frame_idx, object_id, round(min(x) / 640, 6) AS x, round(min(y) / 480, 6) AS y, round((max(x) - min(x) + 1) / 640, 6) AS w, round((max(y) - min(y) + 1) / 480, 6) AS h, 1.0::DOUBLE AS score FROM pixels GROUP BY 1, 2")
def mask_boxes(spark, d):
    return r6(masks.bounding_boxes(_runs(spark, d), 640, 480))


@register("mask_overlaps", f"WITH {views.PIXELS} SELECT p.frame_idx, p.object_id AS a, q.object_id AS b, count(*) AS overlap FROM pixels p JOIN pixels q ON p.frame_idx = q.frame_idx AND p.x = q.x AND p.y = q.y AND p.object_id < q.object_id GROUP BY 1, 2, 3")
def mask_overlaps(spark, d):
    return masks.overlaps(_runs(spark, d))


@register("mask_iou", f"""WITH {views.PIXELS}, n AS (SELECT frame_idx, object_id, count(*) AS n FROM pixels GROUP BY 1, 2),
o AS (SELECT p.frame_idx, p.object_id AS a, q.object_id AS b, count(*) AS overlap FROM pixels p JOIN pixels q ON p.frame_idx = q.frame_idx AND p.x = q.x AND p.y = q.y AND p.object_id < q.object_id GROUP BY 1, 2, 3)
SELECT o.frame_idx, a, b, overlap, round(overlap / (x.n + y.n - overlap), 6) AS iou, round(overlap / x.n, 6) AS "precision" FROM o JOIN n x ON o.frame_idx = x.frame_idx AND x.object_id = a JOIN n y ON o.frame_idx = y.frame_idx AND y.object_id = b""")
def mask_iou(spark, d):
    return r6(masks.similarity(_runs(spark, d)))


BOUNDARY = views.PIXELS + """,
boundary AS (
    SELECT p.* FROM pixels p LEFT JOIN pixels l ON p.frame_idx = l.frame_idx AND p.object_id = l.object_id AND l.x = p.x - 1 AND l.y = p.y LEFT JOIN pixels r ON p.frame_idx = r.frame_idx AND p.object_id = r.object_id AND r.x = p.x + 1 AND r.y = p.y
    LEFT JOIN pixels u ON p.frame_idx = u.frame_idx AND p.object_id = u.object_id AND u.x = p.x AND u.y = p.y - 1 LEFT JOIN pixels w ON p.frame_idx = w.frame_idx AND p.object_id = w.object_id AND w.x = p.x AND w.y = p.y + 1
    WHERE l.x IS NULL OR r.x IS NULL OR u.x IS NULL OR w.x IS NULL
)"""


@register("mask_boundary", f"WITH {BOUNDARY} SELECT frame_idx, object_id, count(*) AS pixels, CAST(sum(x * 31 + y) AS BIGINT) AS mark FROM boundary GROUP BY 1, 2")
def mask_boundary(spark, d):
    return masks.boundary(_runs(spark, d)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("x") * 31 + F.col("y")).alias("mark"))


@register("contour_sample", f"""WITH {BOUNDARY}, o AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, object_id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY frame_idx, object_id) AS n FROM boundary),
k AS (SELECT unnest(range(10)) AS k) SELECT frame_idx, object_id, count(*) AS points, CAST(sum(x * 31 + y) AS BIGINT) AS mark FROM o WHERE n <= 10 OR EXISTS (SELECT 1 FROM k WHERE (k.k * (n - 1)) // 9 = i) GROUP BY 1, 2""")
def contour_sample(spark, d):
    out = masks.contour_sample(masks.boundary(_runs(spark, d)), 10)
    return out.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("x") * 31 + F.col("y")).alias("mark"))


@register("contour_distances", f"WITH {BOUNDARY} SELECT p.frame_idx, p.object_id AS a, q.object_id AS b, round(min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 6) AS distance FROM boundary p JOIN boundary q ON p.frame_idx = q.frame_idx AND p.object_id < q.object_id GROUP BY 1, 2, 3")
def contour_distances(spark, d):
    runs = masks.merged(views.runs(spark, d), within=["frame_idx"])
    return r6(masks.contour_distances(masks.boundary_runs(runs), together=True))


AXES = ", ".join(f"{s}.area AS {n}_area, round({s}.cx, 5) AS {n}_cx, round({s}.cy, 5) AS {n}_cy, round({s}.major, 4) AS {n}_major, round(CASE WHEN {s}.minor < 1e-5 THEN 0 ELSE {s}.minor END, 4) AS {n}_minor" for s, n in (("a", "a"), ("r", "b")))


@register("frame_features", f"""WITH {MOMENTS}{BOUNDARY.removeprefix(views.PIXELS)}, o AS (SELECT p.frame_idx, count(*) AS overlap FROM pixels p JOIN pixels q ON p.frame_idx = q.frame_idx AND p.x = q.x AND p.y = q.y AND p.object_id = 'A' AND q.object_id = 'R' GROUP BY 1),
a AS (SELECT * FROM s WHERE object_id = 'A'), r AS (SELECT * FROM s WHERE object_id = 'R'), k AS (SELECT unnest(range(200)) AS k),
e AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY frame_idx, object_id) AS n FROM boundary WHERE object_id IN ('A', 'R') WINDOW w AS (PARTITION BY frame_idx, object_id ORDER BY y, x)),
h AS (SELECT * FROM e WHERE n <= 200 OR EXISTS (SELECT 1 FROM k WHERE (k.k * (n - 1)) // 199 = i)),
c AS (SELECT p.frame_idx, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS contour FROM h p JOIN h q ON p.frame_idx = q.frame_idx AND p.object_id = 'A' AND q.object_id = 'R' GROUP BY 1)
SELECT coalesce(a.frame_idx, r.frame_idx) AS frame_idx, {AXES}, round(sqrt((r.cx - a.cx) ** 2 + (r.cy - a.cy) ** 2), 5) AS centroid_distance, round(contour, 5) AS min_contour_distance, CASE WHEN a.area IS NOT NULL AND r.area IS NOT NULL THEN coalesce(overlap, 0) END AS overlap_area, a.area + r.area AS combined_area
FROM a FULL JOIN r ON a.frame_idx = r.frame_idx LEFT JOIN o ON coalesce(a.frame_idx, r.frame_idx) = o.frame_idx LEFT JOIN c ON coalesce(a.frame_idx, r.frame_idx) = c.frame_idx""")
def frame_features(spark, d):
    out = masks.frame_features(_runs(spark, d), "A", "R")
    for s in "ab":
        out = out.withColumn(f"{s}_minor", F.when(F.col(f"{s}_minor") < 1e-5, 0.0).otherwise(F.col(f"{s}_minor")))
    sides = [f"{s}_{c}" for s in "ab" for c in ("area", "cx", "cy", "major", "minor")]
    digits = {f"{s}_{c}": n for s in "ab" for c, n in (("cx", 5), ("cy", 5), ("major", 4), ("minor", 4))}
    return _r(out.select("frame_idx", *sides, "centroid_distance", "min_contour_distance", "overlap_area", "combined_area"), centroid_distance=5, min_contour_distance=5, **digits)


@register("frame_angles", f"""WITH {MOMENTS}, t AS (SELECT *, CASE WHEN major - minor > 1e-3 AND abs(vxy) > 1e-6 THEN atan2(2 * vxy, vxx - vyy) / 2 END AS o FROM s),
p AS (SELECT a.frame_idx, a.o AS oa, r.o AS ob, r.cx - a.cx AS dx, r.cy - a.cy AS dy FROM (SELECT * FROM t WHERE object_id = 'A') a JOIN (SELECT * FROM t WHERE object_id = 'R') r ON a.frame_idx = r.frame_idx)
SELECT frame_idx, round(cos(2 * (oa - ob)), 4) AS body, round(cos(atan2(dy, dx) - oa), 4) AS heading_a, round(cos(atan2(-dy, -dx) - ob), 4) AS heading_b, round(abs(sin(atan2(dy, dx) - oa)), 4) AS side_a FROM p WHERE oa IS NOT NULL AND ob IS NOT NULL AND (abs(dx) > 1e-9 OR abs(dy) > 1e-9)""")
def frame_angles(spark, d):
    """Body angle and headings where both masks have an axis, as cosines and sines: two angles that mean the same are equal so."""
    out = masks.frame_features(_runs(spark, d), "A", "R")
    has = lambda s: (F.col(f"{s}_major") - F.col(f"{s}_minor") > 1e-3) & ((F.col(f"{s}_major") - F.col(f"{s}_minor")) * F.abs(F.sin(2 * F.col(f"{s}_orientation"))) * (F.col(f"{s}_major") + F.col(f"{s}_minor")) / 2 > 1e-6)
    out = out.where(has("a") & has("b") & (F.col("centroid_distance") > 1e-9))
    out = out.select("frame_idx", F.cos(2 * F.col("relative_body_angle")).alias("body"), F.cos("heading_a_to_b").alias("heading_a"), F.cos("heading_b_to_a").alias("heading_b"), F.abs(F.sin("heading_a_to_b")).alias("side_a"))
    return _r(out, body=4, heading_a=4, heading_b=4, side_a=4)


@register("object_pair", """WITH k AS (SELECT l_suppkey AS video, l_orderkey AS frame_idx, list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))) AS k FROM lineitem GROUP BY 1, 2),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_idx) AS r FROM k) WHERE r <= 50),
g AS (SELECT video, arg_min(k, frame_idx) FILTER (len(k) >= 2) AS two, arg_min(k, frame_idx) AS one FROM p GROUP BY 1) SELECT video, coalesce(two[1], one[1]) AS object_a, coalesce(two[2], one[2], '') AS object_b FROM g""")
def object_pair(spark, d):
    return masks.object_pair(_numbered_lines(spark, d), "video", first=50)


@register("object_pair_all", """WITH k AS (SELECT l_suppkey AS video, l_orderkey AS frame_idx, list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))) AS k FROM lineitem GROUP BY 1, 2),
g AS (SELECT video, arg_min(k, frame_idx) FILTER (len(k) >= 2) AS two, arg_min(k, frame_idx) AS one FROM k GROUP BY 1) SELECT video, coalesce(two[1], one[1]) AS object_a, coalesce(two[2], one[2], '') AS object_b FROM g""")
def object_pair_all(spark, d):
    return masks.object_pair(_numbered_lines(spark, d), "video")


def _numbered_lines(spark, d):
    return views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("video"), F.col("l_orderkey").alias("frame_idx"), F.col("l_linenumber").cast("string").alias("object_id"))


@register("box_pairs", f"""WITH {views.BOXES}, k AS (SELECT frame_idx, object_id AS o, x * 640 AS x, y * 480 AS y, w * 640 AS w, h * 480 AS h FROM boxes WHERE w > 0 AND h > 0),
p AS (SELECT a.frame_idx, a.o || ':' || b.o AS pair, round(sqrt(greatest(a.x - (b.x + b.w), b.x - (a.x + a.w), 0) ** 2 + greatest(a.y - (b.y + b.h), b.y - (a.y + a.h), 0) ** 2), 9) AS gap, sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) AS centre FROM k a JOIN k b ON a.frame_idx = b.frame_idx AND a.o < b.o),
m AS (SELECT frame_idx, count(*) AS pairs, min(struct_pack(g := gap, p := pair, c := centre)) AS m FROM p GROUP BY 1) SELECT frame_idx, pairs, m.p AS pair, round(m.g, 5) AS gap_px, round(m.c, 5) AS centre_px, round(m.g / 800, 6) AS gap_norm, round(m.c / 800, 6) AS centre_norm FROM m""")
def box_pairs(spark, d):
    return _r(masks.box_pairs(views.boxes(spark, d), 640, 480), gap_px=5, centre_px=5, gap_norm=6, centre_norm=6)


#: No mask has more than seven columns, so that the least number of a component reaches all its runs in as many rounds.
_TIMES = 14


@register("mask_components", f"""WITH {views.PIXELS}, c AS (SELECT frame_idx, object_id, x, y, y - row_number() OVER (PARTITION BY frame_idx, object_id, x ORDER BY y) AS island FROM pixels),
r AS (SELECT frame_idx, object_id, x, min(y) AS a, max(y) AS b, row_number() OVER (PARTITION BY frame_idx, object_id ORDER BY x, min(y)) AS i FROM c GROUP BY frame_idx, object_id, x, island),
l0 AS (SELECT *, i AS part FROM r), {", ".join(f"l{k + 1} AS (SELECT p.frame_idx, p.object_id, p.x, p.a, p.b, p.i, least(p.part, coalesce(min(q.part), p.part)) AS part FROM l{k} p LEFT JOIN l{k} q ON p.frame_idx = q.frame_idx AND p.object_id = q.object_id AND abs(p.x - q.x) = 1 AND p.a <= q.b + 1 AND q.a <= p.b + 1 GROUP BY p.frame_idx, p.object_id, p.x, p.a, p.b, p.i, p.part)" for k in range(_TIMES))},
s AS (SELECT frame_idx, object_id, part, sum(b - a + 1) AS size FROM l{_TIMES} GROUP BY ALL)
SELECT frame_idx, object_id, count(*) AS components, count(*) FILTER (size >= greatest(3, 0.12 * area)) AS large FROM (SELECT *, sum(size) OVER (PARTITION BY frame_idx, object_id) AS area FROM s) GROUP BY 1, 2""")
def mask_components(spark, d):
    return masks.large_components(_runs(spark, d), least=3, together=True)


QUALITY = views.PIXELS + """,
b AS (SELECT frame_idx, object_id, count(*) AS area, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM pixels GROUP BY 1, 2),
q AS (SELECT *, area / 20000 AS cov, area / (bw * bh) AS fill FROM b),
r AS (SELECT *, cov < 0.0004 AS vs, cov >= 0.0004 AND cov < 0.0015 AS sm, fill < 0.12 AS th, bw / 640 < 0.01 OR bh / 480 < 0.01 AS ti FROM q)"""


@register("mask_quality", f"""WITH {QUALITY}, c AS (SELECT *, round(0.72::DOUBLE * CASE WHEN vs THEN 0.35 ELSE 1 END * CASE WHEN sm THEN 0.7 ELSE 1 END * CASE WHEN th THEN 0.65 ELSE 1 END * CASE WHEN ti THEN 0.4 ELSE 1 END, 4) AS confidence,
concat_ws(',', CASE WHEN vs THEN 'mask_very_small' END, CASE WHEN sm THEN 'mask_small' END, CASE WHEN th THEN 'fragmented_or_thin' END, CASE WHEN ti THEN 'tiny_bbox' END) AS said FROM r)
SELECT frame_idx, object_id, round(cov, 6) AS coverage, confidence, CASE WHEN said = '' THEN 'ok' ELSE said END AS reason, confidence >= 0.45 AS ok FROM c""")
def mask_quality(spark, d):
    r = _runs(spark, d).groupBy(*KEYS).agg(F.sum("len").alias("area"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max(F.col("y0") + F.col("len")) - F.min("y0")).alias("bh"))
    return masks.quality(r, 20000, 640, 480).select(*KEYS, "coverage", "confidence", "reason", "ok")


@register("same_place", f"WITH {views.BOXES}, c AS (SELECT frame_idx, object_id AS o, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes) SELECT p.frame_idx, p.o AS a, q.o AS b FROM c p JOIN c q ON p.frame_idx = q.frame_idx AND p.o < q.o AND abs(p.cx - q.cx) < 0.0799 AND abs(p.cy - q.cy) < 0.0799")
def same_place(spark, d):
    return masks.same_place(views.boxes(spark, d), 0.0799)


@register("frame_verdicts", f"""WITH {QUALITY}, s AS (SELECT DISTINCT frame_idx FROM b), o AS (SELECT unnest(['A', 'R', 'N']) AS object_id), m AS (SELECT frame_idx, object_id, NOT th AS ok FROM r)
SELECT s.frame_idx, count(*) AS expected, count(ok) AS found, count(*) - count(ok) AS missing, bool_and(coalesce(ok, false)) AS all_ok FROM s CROSS JOIN o LEFT JOIN m ON s.frame_idx = m.frame_idx AND o.object_id = m.object_id GROUP BY 1""")
def frame_verdicts(spark, d):
    r = _runs(spark, d).groupBy(*KEYS).agg(F.sum("len").alias("area"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max(F.col("y0") + F.col("len")) - F.min("y0")).alias("bh"))
    ok = r.select(*KEYS, (F.col("area") / (F.col("bw") * F.col("bh")) >= 0.12).alias("ok"))
    return masks.frame_verdicts(ok, spark.createDataFrame([("A",), ("R",), ("N",)], "object_id string"))


@register("pick_left", f"WITH {views.BOXES}, c AS (SELECT frame_idx, object_id, round(x + w / 2, 6) AS cx FROM boxes) SELECT frame_idx, coalesce(min(cx) FILTER (cx < 0.55), min(cx)) AS cx FROM c GROUP BY 1")
def pick_left(spark, d):
    c = views.boxes(spark, d).select("frame_idx", F.col("object_id").alias("detection"), F.round(F.col("x") + F.col("w") / 2, 6).alias("cx"))
    return masks.pick(c, "left", ["frame_idx"]).select("frame_idx", "cx")


@register("pick_right", f"WITH {views.BOXES}, c AS (SELECT frame_idx, round(x + w / 2, 6) AS cx FROM boxes) SELECT frame_idx, coalesce(max(cx) FILTER (cx >= 0.55 AND cx < 0.74), max(cx) FILTER (cx < 0.74), max(cx)) AS cx FROM c GROUP BY 1")
def pick_right(spark, d):
    c = views.boxes(spark, d).select("frame_idx", F.col("object_id").alias("detection"), F.round(F.col("x") + F.col("w") / 2, 6).alias("cx"))
    return masks.pick(c, "right", ["frame_idx"]).select("frame_idx", "cx")


@register("object_centres", f"""WITH {views.BOXES}, {views.PIXELS.strip()}, m AS (SELECT frame_idx, object_id, avg(x) / 640 AS mx, avg(y) / 480 AS my FROM pixels GROUP BY 1, 2)
SELECT coalesce(b.frame_idx, m.frame_idx) AS frame_idx, coalesce(b.object_id, m.object_id) AS object_id, CAST(floor(coalesce(x + w / 2, mx, 0.5) * 10000 + 0.3) AS BIGINT) AS cx, CAST(floor(coalesce(y + h / 2, my, 0.5) * 10000 + 0.3) AS BIGINT) AS cy FROM boxes b FULL JOIN m ON b.frame_idx = m.frame_idx AND b.object_id = m.object_id""")
def object_centres(spark, d):
    m = masks.shapes(_runs(spark, d)).select(*KEYS, (F.col("cx") / 640).alias("mx"), (F.col("cy") / 480).alias("my"))
    steady = lambda c: F.floor(F.col(c) * 10000 + 0.3).cast("long").alias(c)
    return masks.centres(views.boxes(spark, d), m).select(*KEYS, steady("cx"), steady("cy"))


@register("mask_fingerprints", f"""WITH {views.PIXELS}, c AS (SELECT frame_idx, object_id, x, y, y - row_number() OVER (PARTITION BY frame_idx, object_id, x ORDER BY y) AS island FROM pixels),
r AS (SELECT frame_idx, object_id, x, min(y) AS y0, count(*) AS len FROM c GROUP BY frame_idx, object_id, x, island), t AS (SELECT frame_idx, object_id, lpad(CAST(x AS VARCHAR), 6, '0') || ':' || lpad(CAST(y0 AS VARCHAR), 6, '0') || ':' || len AS t FROM r)
SELECT frame_idx, object_id, substr(sha256(string_agg(t, ',' ORDER BY t)), 1, 16) AS fingerprint FROM t GROUP BY 1, 2""")
def mask_fingerprints(spark, d):
    return masks.fingerprint(_runs(spark, d))


@register("truth_matches", f"""WITH {views.PIXELS}, n AS (SELECT frame_idx, object_id, count(*) AS n FROM pixels GROUP BY 1, 2), o AS (SELECT p.frame_idx, p.object_id AS a, q.object_id AS b, count(*) AS overlap FROM pixels p JOIN pixels q ON p.frame_idx = q.frame_idx AND p.x = q.x AND p.y = q.y AND p.object_id < q.object_id GROUP BY 1, 2, 3),
s AS (SELECT o.frame_idx, a, b, overlap / (x.n + y.n - overlap) AS iou, overlap / x.n AS prec FROM o JOIN n x ON o.frame_idx = x.frame_idx AND x.object_id = a JOIN n y ON o.frame_idx = y.frame_idx AND y.object_id = b) SELECT frame_idx, a, b, round(iou, 6) AS iou, round(prec, 6) AS "precision", iou >= 0.25 AND prec >= 0.35 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, a ORDER BY iou DESC, b) AS place FROM s) WHERE place = 1""")
def truth_matches(spark, d):
    """Masks of the flag A, which may overlap N and R: of equal overlaps the first counts."""
    return r6(masks.best_match(masks.similarity(_runs(spark, d)), ["frame_idx", "a"], "b"))


@register("frame_checks", f"""WITH {views.BOXES}, e AS (SELECT * FROM (VALUES ('1', 'left'), ('2', 'right'), ('3', NULL)) AS t(object_id, side)), f AS (SELECT frame_idx, object_id, x, y, w, h, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes),
s AS (SELECT DISTINCT p.frame_idx, unnest([p.object_id, q.object_id]) AS object_id FROM f p JOIN f q ON p.frame_idx = q.frame_idx AND p.object_id < q.object_id AND abs(p.cx - q.cx) < 0.0799 AND abs(p.cy - q.cy) < 0.0799),
r AS (SELECT k.frame_idx, e.object_id, e.side, cx, s.object_id IS NOT NULL AS shared FROM (SELECT DISTINCT frame_idx FROM f) k CROSS JOIN e LEFT JOIN f ON f.frame_idx = k.frame_idx AND f.object_id = e.object_id LEFT JOIN s ON s.frame_idx = k.frame_idx AND s.object_id = e.object_id),
w AS (SELECT *, max(CASE WHEN side = 'left' THEN cx END) OVER p > max(CASE WHEN side = 'right' THEN cx END) OVER p AS swapped FROM r WINDOW p AS (PARTITION BY frame_idx)),
t AS (SELECT frame_idx, object_id, concat_ws(',', CASE WHEN cx IS NULL THEN 'missing_mask' END, CASE WHEN shared THEN 'same_location_as_other_object' END, CASE WHEN cx BETWEEN 0.42 AND 0.56 THEN 'likely_bedding' END, CASE WHEN cx >= 0.74 THEN 'likely_water_port' END, CASE WHEN swapped AND side IS NOT NULL THEN 'identity_swap' END) AS said FROM w)
SELECT frame_idx, object_id, said = '' AS ok, CASE WHEN said = '' THEN 'ok' ELSE said END AS reason FROM t""")
def frame_checks(spark, d):
    found = views.boxes(spark, d).select("*", F.lit(True).alias("ok"), F.lit("ok").alias("reason"), F.lit(100).alias("area"))
    expected = spark.createDataFrame([("1", "left"), ("2", "right"), ("3", None)], "object_id string, side string")
    return masks.frame_checks(found, expected, 0.0799)


@register("warped_masks", f"""WITH {views.PIXELS}, b AS (SELECT frame_idx, object_id, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM pixels GROUP BY 1, 2),
g AS (SELECT frame_idx, object_id, px, unnest(range(CAST(greatest(0, floor(0.1 * x0 + 1.2 * y0 + 2)) AS BIGINT), CAST(least(79, ceil(0.1 * x1 + 1.2 * y1 + 2)) AS BIGINT) + 1)) AS py FROM (SELECT *, unnest(range(CAST(greatest(0, floor(1.5 * x0 + 0.2 * y0 + 3)) AS BIGINT), CAST(least(79, ceil(1.5 * x1 + 0.2 * y1 + 3)) AS BIGINT) + 1)) AS px FROM b)),
i AS (SELECT *, CAST(round((1.2 * (px - 3) - 0.2 * (py - 2)) / 1.78) AS BIGINT) AS x, CAST(round((1.5 * (py - 2) - 0.1 * (px - 3)) / 1.78) AS BIGINT) AS y FROM g),
h AS (SELECT i.* FROM i JOIN pixels p ON p.frame_idx = i.frame_idx AND p.object_id = i.object_id AND p.x = i.x AND p.y = i.y) SELECT frame_idx, object_id, count(*) AS area, CAST(sum(px * 131 + py) AS BIGINT) AS mark FROM h GROUP BY 1, 2""")
def warped_masks(spark, d):
    from driftmark.operators import registration

    h = [F.lit(float(v)) for v in (1.5, 0.2, 3, 0.1, 1.2, 2, 0, 0, 1)]
    out = registration.warp(_runs(spark, d), h, 80, 80, joined=False)
    n = F.col("len")
    return out.groupBy(*KEYS).agg(F.sum(n).alias("area"), F.sum(n * (F.col("x") * 131 + F.col("y0")) + F.shiftright(n * (n - 1), 1)).alias("mark"))  # sums over the pixels of a run


@register("box_pairs_at_frames", oracle_sql()["box_pairs"].replace("WHERE w > 0", "WHERE frame_idx IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND w > 0"))
def box_pairs_at_frames(spark, d):
    wanted = views.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("frame_idx"))
    return _r(masks.box_pairs(masks.at_frames(views.boxes(spark, d), wanted), 640, 480), gap_px=5, centre_px=5, gap_norm=6, centre_norm=6)


@register("stored_masks", f"WITH {views.PIXELS} SELECT CAST(frame_idx // 4096 AS VARCHAR) AS video_id, frame_idx, object_id, count(*) AS area, CAST(sum(x * 31 + y) AS BIGINT) AS mark, count(DISTINCT x) AS columns FROM pixels GROUP BY 1, 2, 3")
def stored_masks(spark, d):
    """All masks packed into stores, 4,096 orders a video, and read back."""
    runs = views.runs(spark, d).withColumn("video_id", F.floor(F.col("frame_idx") / 4096).cast("string"))
    back = stored.mask_runs(stored.packed_stores(runs, height=64))
    x, y0, n = F.col("x"), F.col("y0"), F.col("len")
    marks = F.sum(n * (x * 31 + y0) + F.floor(n * (n - 1) / 2).cast("long"))
    return back.groupBy("video_id", *KEYS).agg(F.sum("len").alias("area"), marks.alias("mark"), F.countDistinct("x").alias("columns"))
