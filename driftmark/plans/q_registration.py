"""Queries on registration and pose annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import registration
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_tracks import _r, r6

H = (1.1, 0.02, 5.0, -0.03, 0.9, 7.0, 0.0001, 0.0002, 1.0)


def _points(spark, d):
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y"))


@register("projected_points", f"SELECT l_orderkey AS id, l_linenumber AS line, round((1.1 * x + 0.02 * y + 5) / w + 3, 4) AS x, round((-0.03 * x + 0.9 * y + 7) / w + 2, 4) AS y FROM (SELECT *, 0.0001 * x + 0.0002 * y + 1 AS w FROM (SELECT *, l_quantity * 10 AS x, l_discount * 1000 AS y FROM lineitem))")
def projected_points(spark, d):
    x, y = registration.project(F.col("x"), F.col("y"), [F.lit(v) for v in H], 3.0, 2.0)
    return _r(_points(spark, d).select("id", "line", x.alias("x"), y.alias("y")), x=4, y=4)


@register("canvas", "SELECT CAST(least(floor(min(x)), 0) AS BIGINT) AS x0, CAST(least(floor(min(y)), 0) AS BIGINT) AS y0, CAST(greatest(ceil(max(x)), 300) AS BIGINT) AS x1, CAST(greatest(ceil(max(y)), 300) AS BIGINT) AS y1, true AS ok FROM (SELECT l_quantity * 10 - 20.5 AS x, l_discount * 1000 AS y FROM lineitem)")
def canvas(spark, d):
    return registration.canvas(_points(spark, d).select((F.col("x") - 20.5).alias("x"), "y"), 300)


CORNERS = "c AS (SELECT c_custkey AS id, 10.0 + c_custkey % 7 AS x1, 12.0 + c_custkey % 5 AS y1, 200.0 + c_custkey % 11 AS x2, 15.0 + c_custkey % 3 AS y2, 210.0 + c_custkey % 6 AS x3, 180.0 + c_custkey % 8 AS y3, 8.0 + c_custkey % 4 AS x4, 170.0 + c_custkey % 9 AS y4 FROM customer)"


def _corners(spark, d):
    k = F.col("c_custkey")
    at = {"x1": (10.0, 7), "y1": (12.0, 5), "x2": (200.0, 11), "y2": (15.0, 3), "x3": (210.0, 6), "y3": (180.0, 8), "x4": (8.0, 4), "y4": (170.0, 9)}
    return views.table(spark, d, "customer").select(k.alias("id"), *[(F.lit(a) + k % m).alias(n) for n, (a, m) in at.items()])


@register("ordered_corners", f"WITH {CORNERS} SELECT id, x1 AS tl, x2 AS tr, x3 AS br, x4 AS bl FROM c")
def ordered_corners(spark, d):
    long = _corners(spark, d).select("id", F.explode(F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (3, 1, 4, 2)])).alias("p")).select("id", "p.x", "p.y")
    return registration.ordered_corners(long, "id").select("id", F.col("tl.x").alias("tl"), F.col("tr.x").alias("tr"), F.col("br.x").alias("br"), F.col("bl.x").alias("bl"))


@register("affine_of_corners", f"""WITH {CORNERS}, l AS (SELECT id, unnest([x1, x2, x3, x4]) AS x, unnest([y1, y2, y3, y4]) AS y, unnest([0.0, 99.0, 99.0, 0.0]) AS gx FROM c), m AS (SELECT id, avg(x) AS mx, avg(y) AS my, avg(gx) AS mg FROM l GROUP BY 1),
s AS (SELECT l.id, any_value(mx) AS mx, any_value(my) AS my, any_value(mg) AS mg, sum((x - mx) ** 2) AS sxx, sum((y - my) ** 2) AS syy, sum((x - mx) * (y - my)) AS sxy, sum((x - mx) * gx) AS tx, sum((y - my) * gx) AS ty FROM l JOIN m ON l.id = m.id GROUP BY 1)
SELECT id, round((tx * syy - ty * sxy) / (sxx * syy - sxy * sxy), 6) AS a, round((ty * sxx - tx * sxy) / (sxx * syy - sxy * sxy), 6) AS b FROM s""")
def affine_of_corners(spark, d):
    c = _corners(spark, d)
    a = registration.affine_of_corners([(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3, 4)], F.lit(100.0))
    return r6(c.select("id", a[0].alias("a"), a[1].alias("b")))


@register("known_registration", "SELECT c_custkey AS video_id, CASE WHEN c_custkey % 3 = 0 THEN 'h' || c_custkey END AS h, CASE WHEN c_custkey % 2 = 0 THEN 800 ELSE 640 END AS frame_width FROM customer")
def known_registration(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    k = F.col("video_id")
    known = c.where("video_id % 2 = 0 OR video_id % 3 = 0").select(k, (k % 3 == 0).alias("registered"), F.concat(F.lit("h"), k.cast("string")).alias("h"), F.when(k % 2 == 0, 800).alias("frame_width"), F.lit(None).cast("int").alias("frame_height"))
    return registration.known_registration(c, known).select("video_id", "h", "frame_width")


POSES = "p AS (SELECT DISTINCT l_suppkey AS video_id, 'o' AS object_id, 'p' || (l_linenumber % 3) AS part_id, l_orderkey AS frame_idx FROM lineitem)"


def _poses(spark, d):
    line = views.table(spark, d, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("video_id"), F.concat(F.lit("p"), F.col("l_linenumber") % 3).alias("part"), F.col("l_orderkey").cast("string").alias("frame"))
    # Whole videos in tasks of about as many rows, so that there are more tasks for more rows.
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-line.count() // 200_000)), "video_id").distinct()
    point = F.struct(F.lit(True).alias("visible"), F.lit(0.25).alias("x"), F.lit(0.75).alias("y"))
    frames = rows.groupBy("video_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("frame", point))).alias("f"))
    parts = frames.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "f"))).alias("p"))
    return parts.select("video_id", F.create_map(F.lit("o"), "p").alias("poses"))


@register("pose_rows", f"WITH {POSES} SELECT video_id, object_id, part_id, frame_idx, 0.25::DOUBLE AS x, 0.75::DOUBLE AS y, true AS visible FROM p")
def pose_rows(spark, d):
    return registration.pose_rows(_poses(spark, d))


@register("reference_frames", f"""WITH {POSES}, n AS (SELECT video_id, count(DISTINCT object_id || '/' || part_id) AS parts FROM p GROUP BY 1), f AS (SELECT p.video_id, frame_idx FROM p JOIN n ON p.video_id = n.video_id GROUP BY 1, 2, parts HAVING count(*) = parts)
SELECT video_id, arg_min(frame_idx, struct_pack(d := abs(frame_idx - 5000), f := frame_idx)) AS reference, count(*) AS full_frames FROM f GROUP BY 1""")
def reference_frames(spark, d):
    return registration.reference_frames(registration.pose_rows(_poses(spark, d)), 5000)


@register("nearest_frames", """WITH w AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS video_id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS start FROM lineitem),
f AS (SELECT DISTINCT l_partkey AS video_id, CAST(floor(l_extendedprice) AS BIGINT) % 2600 AS frame_idx FROM lineitem WHERE l_returnflag = 'R')
SELECT id, line, w.video_id, start, arg_min(frame_idx, struct_pack(d := abs(frame_idx - start), f := frame_idx)) AS nearest FROM w LEFT JOIN f ON w.video_id = f.video_id GROUP BY ALL""")
def nearest_frames(spark, d):
    """Of each part's lines the nearest place among those of its returned lines; parts without returned lines have none."""
    line = views.table(spark, d, "lineitem")
    wanted = line.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("video_id"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("start"))
    frames = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("video_id"), (F.floor("l_extendedprice") % 2600).alias("frame_idx"))
    return registration.nearest_frames(wanted, frames, chunk=500)


@register("memory_weights", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN v THEN round(CASE WHEN prev THEN 0.4 ELSE 1.0 END / count(CASE WHEN v THEN 1 END) OVER (PARTITION BY l_suppkey, l_returnflag), 9) END AS weight FROM (SELECT *, l_linenumber % 2 = 0 AS v, l_orderkey % 2 = 0 AS prev FROM lineitem)")
def memory_weights(spark, d):
    a = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("video_id"), F.col("l_returnflag").alias("part_id"), (F.col("l_linenumber") % 2 == 0).alias("visible"), (F.col("l_orderkey") % 2 == 0).alias("has_previous"))
    return _r(registration.memory_weights(a).select("id", "line", "weight"), weight=9)


FLOOR = ((100.0, 20.0), (400.0, 30.0), (420.0, 90.0), (90.0, 80.0))


def _blend_sql():
    import numpy as np

    c, goal = np.array(FLOOR), np.array([[0, 0], [99, 0], [99, 99], [0, 99]], float)
    a = np.linalg.lstsq(np.column_stack([c, np.ones(4)]), goal, rcond=None)[0].T
    sides, signs = [], []
    for (ax, ay), (bx, by) in zip(FLOOR, [*FLOOR[1:], FLOOR[0]]):
        ex, ey = bx - ax, by - ay
        t = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - {ax}::DOUBLE) * {ex}::DOUBLE + (y - {ay}::DOUBLE) * {ey}::DOUBLE) / {ex * ex + ey * ey}::DOUBLE))"
        sides.append(f"sqrt((x - {ax}::DOUBLE - {t} * {ex}::DOUBLE) ** 2 + (y - {ay}::DOUBLE - {t} * {ey}::DOUBLE) ** 2)")
        signs.append(f"({ex}::DOUBLE * (y - {ay}::DOUBLE) - {ey}::DOUBLE * (x - {ax}::DOUBLE))")
    low = min(abs(H[6] * x + H[7] * y + H[8]) for x, y in FLOOR)
    return f"""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity * 10 AS x, l_discount * 1000 AS y FROM lineitem),
d AS (SELECT *, CASE WHEN least({", ".join(signs)}) >= 0 OR greatest({", ".join(signs)}) <= 0 THEN 0 ELSE least({", ".join(sides)}) END AS far, {H[6]}::DOUBLE * x + {H[7]}::DOUBLE * y + {H[8]}::DOUBLE AS w FROM p),
e AS (SELECT *, least(1, greatest(0, 1 - far / (0.45::DOUBLE * 800))) AS f, least(1, greatest(0, (abs(w) - {0.15 * low}::DOUBLE) / {0.35 * low}::DOUBLE)) AS s FROM d),
k AS (SELECT *, f * f * (3 - 2 * f) * s * s * (3 - 2 * s) * CASE WHEN w > 0 THEN 1 ELSE 0 END AS k FROM e)
SELECT id, line, round(k * ({H[0]}::DOUBLE * x + {H[1]}::DOUBLE * y + {H[2]}::DOUBLE) / w + (1 - k) * ({a[0, 0]}::DOUBLE * x + {a[0, 1]}::DOUBLE * y + {a[0, 2]}::DOUBLE), 4) AS x,
round(k * ({H[3]}::DOUBLE * x + {H[4]}::DOUBLE * y + {H[5]}::DOUBLE) / w + (1 - k) * ({a[1, 0]}::DOUBLE * x + {a[1, 1]}::DOUBLE * y + {a[1, 2]}::DOUBLE), 4) AS y FROM k"""


@register("blended_points", _blend_sql())
def blended_points(spark, d):
    lit = lambda v: F.lit(float(v))
    x, y = registration.blended(F.col("x"), F.col("y"), [lit(v) for v in H], [(lit(a), lit(b)) for a, b in FLOOR], lit(100), lit(640), lit(480))
    return _r(_points(spark, d).select("id", "line", x.alias("x"), y.alias("y")), x=4, y=4)
