"""Queries on neighbour graphs and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import graph, mixtures
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_tracks import _r, r6

COLUMNS = views.FEATURE_COLUMNS
SQUARES = " + ".join(f"(a.f{i} - b.f{i}) ** 2" for i in range(8))
NEAR = views.FEATURES + f""",
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt({SQUARES}) AS distance FROM features a JOIN features b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS place FROM p) WHERE place <= 10)"""


def _near(spark, d, k=10):
    return graph.nearest(views.features(spark, d), "vec_id", COLUMNS, k)


@register("nearest", f"WITH {NEAR} SELECT src, dst, round(distance, 6) AS distance, place FROM near")
def nearest(spark, d):
    return r6(_near(spark, d).withColumn("place", F.col("place").cast("long")))


@register("nearest_hashed")
def nearest_hashed(spark, d):
    return r6(graph.nearest_hashed(views.features(spark, d), "vec_id", COLUMNS, 10, reach=0.6))


@register("affinity", f"WITH {NEAR}, t AS (SELECT max(distance) AS top FROM near) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(1 - distance / top), 6) AS weight FROM near, t GROUP BY 1, 2")
def affinity(spark, d):
    return r6(graph.affinity(_near(spark, d)))


@register("components")
def components(spark, d):
    """Orders and parts as nodes, all rows of lineitem as edges; too long for a recursive SQL."""
    line = views.table(spark, d, "lineitem")
    return graph.components(line.select(F.col("l_orderkey").cast("long").alias("a"), (-1 - F.col("l_partkey")).cast("long").alias("b")))


@register("communities")
def communities(spark, d):
    return graph.communities(graph.affinity(_near(spark, d, 30)))


@register("modularity")
def modularity(spark, d):
    edges = graph.affinity(_near(spark, d, 30))
    return r6(graph.modularity(edges, graph.communities(edges)))


@register("spectral")
def spectral(spark, d):
    return graph.spectral(graph.affinity(_near(spark, d, 30)))


@register("coordinates")
def coordinates(spark, d):
    return _r(graph.coordinates(graph.affinity(_near(spark, d, 30))), x=4, y=4)


@register("bimodal")
def bimodal(spark, d):
    fits = mixtures.bimodal(views.table(spark, d, "events"), "event_type", "value")
    return _r(fits, mean_low=6, mean_high=6, sd_low=6, sd_high=6, weight_low=6, weight_high=6, threshold=6, bic=3)


@register("bimodal_labels")
def bimodal_labels(spark, d):
    """Values of each event type by the component that they belong to."""
    e = views.table(spark, d, "events").select("event_id", "event_type", "value")
    return mixtures.labels(e, mixtures.bimodal(e, "event_type", "value"), "event_type", "value").groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@register("moving_share")
def moving_share(spark, d):
    e = views.table(spark, d, "events")
    return _r(mixtures.moving_share(e, mixtures.bimodal(e, "event_type", "value"), "event_type", "value"), moving=6)
