"""Mixtures of two normal distributions, fitted by name as iterated sums over distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.operators.graph import Rounds, cut

#: Added to values before their logarithm, and to variances (fixed values).
SHIFT, LEAST_VARIANCE = 1e-6, 1e-6
FIT = ("n", "mean_low", "mean_high", "sd_low", "sd_high", "weight_low", "weight_high", "threshold", "bic")


def _names(key: str) -> dict[str, str]:
    """The columns of a fit; one that the key has already gets an underscore."""
    return {c: c + "_" * (c.lower() == key.lower()) for c in FIT}


def _usable(value: str) -> Column:
    v = F.col(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))


def _densities(v: Column) -> tuple[Column, Column]:
    """Logarithms of both components' weighted densities at v, from columns m0, m1, v0, v1, w0, w1."""
    one = lambda i: F.log(f"w{i}") - 0.5 * F.log(2 * math.pi * F.col(f"v{i}")) - F.pow(v - F.col(f"m{i}"), F.lit(2)) / (2 * F.col(f"v{i}"))
    return one(0), one(1)


def _log_sum(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def _moments(weight: Column, u: Column, i: int) -> list[Column]:
    """Sums of a component: weight, first and second moment."""
    return [F.sum(weight).alias(f"n{i}"), F.sum(weight * u).alias(f"x{i}"), F.sum(weight * u * u).alias(f"q{i}")]


def _estimated(sums: DataFrame, *kept: str) -> DataFrame:
    """Weights, means and variances from the sums of both components."""
    size = lambda i: F.col(f"n{i}") + 1e-15
    mean = lambda i: F.col(f"x{i}") / size(i)
    var = lambda i: F.greatest(F.col(f"q{i}") / size(i) - mean(i) * mean(i), F.lit(0.0)) + LEAST_VARIANCE
    share = lambda i: F.greatest(size(i) / (F.col("n0") + F.col("n1")), F.lit(1e-300))
    return sums.select("key", *[f(i).alias(f"{c}{i}") for c, f in (("w", share), ("m", mean), ("v", var)) for i in (0, 1)], *kept)


def bimodal(samples: DataFrame, name: str, value: str, rounds: int = 100, close: float = 1e-3, least: int = 10, chain: int = 5) -> DataFrame:
    """A mixture of two normal distributions of log(value + 1e-6) for each name.

    Columns: the name, n, mean_low and mean_high (of the values' logarithms, as values), sd_low and sd_high (of the logarithms), weights, threshold (midway between the
    means) and bic. A column that the name's own column is called like gets an underscore. Values that are missing, negative or not finite don't count;
    names with fewer than `least` others have no row. A null name is a name.

    Values are counted, and each round is a sum by name over distinct values and counts, for all names at once, `chain` rounds to a job. The components begin
    as the two means of the values nearest to them, from the least and the largest value on; then expectation and maximization go on until a name's mean log
    likelihood changes by less than `close`. The fit is exact: it depends on no bins and on no order.
    """
    logs = samples.where(_usable(value)).select(F.col(name).alias("key"), F.log(F.col(value).cast("double") + SHIFT).alias("v"))
    counted = logs.groupBy("key", "v").agg(F.count(F.lit(1)).alias("c"))
    span = counted.groupBy("key").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("centre"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n") >= least)
    span = cut(span)
    same = lambda a, b: a.join(b.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    # Values less their name's mean, so that sums of squares lose nothing.
    rows = cut(same(counted, span.select("key", "centre")).select("key", (F.col("v") - F.col("centre")).alias("u"), "c"))
    table = Rounds(samples.sparkSession)
    u, c = F.col("u"), F.col("c")

    middle = table.put(span.select("key", ((F.col("lo") + F.col("hi")) / 2 - F.col("centre")).alias("middle"), F.lit(True).alias("moved")))
    for _ in range(max(1, rounds // chain)):
        for _ in range(chain):
            high = u > F.col("middle")
            sums = same(rows, middle.drop("moved")).groupBy("key", "middle").agg(*_moments(F.when(~high, c).otherwise(0), u, 0), *_moments(F.when(high, c).otherwise(0), u, 1))
            new = F.when((F.col("n0") > 0) & (F.col("n1") > 0), (F.col("x0") / F.col("n0") + F.col("x1") / F.col("n1")) / 2).otherwise(F.col("middle"))
            middle = sums.select("key", new.alias("middle"), (new != F.col("middle")).alias("moved"))
        middle = table.put(middle)
        if middle.where("moved").isEmpty():
            break
    high = u > F.col("middle")
    halves = same(rows, middle.drop("moved")).groupBy("key").agg(*_moments(F.when(~high, c).otherwise(0), u, 0), *_moments(F.when(high, c).otherwise(0), u, 1))
    now = table.put(_estimated(halves).select("*", F.lit(float("-inf")).alias("last"), F.lit(False).alias("done")))
    for _ in range(max(1, rounds // chain)):
        for _ in range(chain):
            a, b = _densities(u)
            both = _log_sum(a, b)
            old = [F.first(x).alias(f"_{x}") for x in ("w0", "w1", "m0", "m1", "v0", "v1", "last", "done")]
            share = F.exp(b - both)
            sums = same(rows, now).groupBy("key").agg(*_moments(c * (1 - share), u, 0), *_moments(c * share, u, 1), (F.sum(c * both) / F.sum(c)).alias("fit"), *old)
            fresh = _estimated(sums, "fit", *[f"_{x}" for x in ("w0", "w1", "m0", "m1", "v0", "v1", "last", "done")])
            kept = [F.when(F.col("_done"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) for x in ("w0", "w1", "m0", "m1", "v0", "v1")]
            now = fresh.select("key", *kept, F.col("fit").alias("last"), (F.col("_done") | (F.abs(F.col("fit") - F.col("_last")) < close)).alias("done"))
        now = table.put(now)
        if now.where("NOT done").isEmpty():
            break
    a, b = _densities(u)
    likely = same(rows, now).groupBy("key").agg(F.sum(c * _log_sum(a, b)).alias("fit"))
    out = same(same(now, likely), span.select("key", "n", "centre"))
    swap = F.col("m0") > F.col("m1")
    side = lambda x, i: F.when(swap, F.col(f"{x}{1 - i}")).otherwise(F.col(f"{x}{i}"))
    named = _names(name)
    columns = {
        "n": F.col("n"), "mean_low": F.exp(side("m", 0) + F.col("centre")), "mean_high": F.exp(side("m", 1) + F.col("centre")), "sd_low": F.sqrt(side("v", 0)), "sd_high": F.sqrt(side("v", 1)),
        "weight_low": side("w", 0), "weight_high": side("w", 1), "threshold": F.exp((F.col("m0") + F.col("m1")) / 2 + F.col("centre")), "bic": 5 * F.log(F.col("n").cast("double")) - 2 * F.col("fit"),
    }
    return out.select(F.col("key").alias(name), *[v.alias(named[k]) for k, v in columns.items()])


def labels(samples: DataFrame, fits: DataFrame, name: str, value: str, label: str = "label") -> DataFrame:
    """samples with the likelier component of each value, 0 low or 1 high (ties: low); null where the name has no fit or the value doesn't count."""
    named = _names(name)
    inner = {"mean_low": "_m0", "mean_high": "_m1", "sd_low": "_s0", "sd_high": "_s1", "weight_low": "_w0", "weight_high": "_w1"}
    known = fits.select(F.col(name).alias("_key"), *[F.col(named[c]).alias(n) for c, n in inner.items()])
    v = F.log(F.col(value).cast("double") + SHIFT)
    one = lambda i: F.log(f"_w{i}") - F.log(f"_s{i}") - F.pow((v - F.log(f"_m{i}")) / F.col(f"_s{i}"), F.lit(2)) / 2
    found = F.when(_usable(value) & F.col("_w0").isNotNull(), (one(1) > one(0)).cast("int"))
    joined = samples.join(known, F.col(name).eqNullSafe(F.col("_key")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in samples.columns], found.alias(label))


def moving_share(samples: DataFrame, fits: DataFrame, name: str, value: str) -> DataFrame:
    """Share of each name's finite values at or above its threshold."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    known = fits.select(F.col(name).alias("_key"), F.col(_names(name)["threshold"]).alias("_threshold"))
    rows = samples.where(finite).select(F.col(name).alias("_name"), v.alias("_v")).join(known, F.col("_name").eqNullSafe(F.col("_key")))
    return rows.groupBy(F.col("_name").alias(name)).agg(F.avg((F.col("_v") >= F.col("_threshold")).cast("double")).alias("moving"))
