"""Summaries and tests on long tables: one row for each unit and feature.

Ranks come from counts by distinct value, which are combined before the shuffle, so that repeated values are one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions import tails
from driftmark.functions.scalars import finite, normal_p, ratio

SUMMARY = ("n", "mean", "sd", "q25", "median", "q75", "min", "max")


def placed(counts: DataFrame, keys: Sequence[str], value: str, chunks: int = 128) -> DataFrame:
    """Adds _below, how many of the key's rows have a smaller value, and _n, how many it has. counts has one row, with the number _c, for each key and value.

    Values are cut at quantiles into chunks, the window runs inside a chunk of a key and the sums of the chunks before are
    added, so that no task sorts all values, with or without keys. Keys may be null.
    """
    points = [i / chunks for i in range(1, chunks)]
    bounds = counts.agg(F.percentile_approx(F.col(value).cast("double"), points, 20 * chunks).alias("_bounds"))  # one row
    chunk = F.size(F.filter("_bounds", lambda b: b <= F.col(value)))
    chunked = counts.crossJoin(F.broadcast(bounds)).withColumn("_chunk", chunk).drop("_bounds")
    by = W.partitionBy(*keys)
    total = F.sum("_m").over(by)
    sums = chunked.groupBy(*keys, "_chunk").agg(F.sum("_c").alias("_m"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_chunk"])], (F.sum("_m").over(by.orderBy("_chunk")) - F.col("_m")).alias("_before"), total.alias("_n"))
    inside = F.sum("_c").over(W.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    dealt = chunked.repartition(*keys, "_chunk").withColumn("_inside", F.coalesce(inside, F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_chunk"])]
    return dealt.join(sums, on).select(*counts.columns, (F.col("_before") + F.col("_inside")).alias("_below"), "_n")


def quantiles(table: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "_q", nan: bool = False) -> DataFrame:
    """Exact interpolated percentiles of each key's finite values as one array of doubles; others don't count, but with `nan` NaN is a value above all others. Without keys, a table without values gives an array of nulls."""
    finite_ = F.col(value).cast("double") if nan else finite(F.col(value).cast("double"))
    counts = table.where(finite_.isNotNull()).groupBy(*keys, finite_.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    at = [F.col("_n") * share - share for share in shares]
    held = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col("_v")))
    ends = [(held(F.floor(p)), held(F.ceil(p)), F.max(p - F.floor(p))) for p in at]
    return placed(counts, keys, "_v").groupBy(*keys).agg(F.array(*[low + (high - low) * part for low, high, part in ends]).alias(name))


def joined(table: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins one row of each key to the table's rows; null keys are keys like others."""
    if not keys:
        return table.crossJoin(F.broadcast(few))  # one row
    named = few.withColumnsRenamed({k: f"_on{i}" for i, k in enumerate(keys)})
    return table.join(named, [F.col(k).eqNullSafe(F.col(f"_on{i}")) for i, k in enumerate(keys)]).drop(*[f"_on{i}" for i in range(len(keys))])


def summary(table: DataFrame, keys: Sequence[str], value: str, nan: bool = False) -> DataFrame:
    """n, mean, sample deviation (0 for one value), quartiles, least and largest of the finite values of each key. Texts that are no numbers are missing.

    With `nan`, NaN is a value above all others, as in SQL: a key that has one has no mean but NaN.
    """
    v = F.col(value).try_cast("double") if nan else finite(F.col(value).try_cast("double"))
    kept = table.select(*keys, v.alias("_x")).where("_x IS NOT NULL")
    out = kept.groupBy(*keys).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    out = joined(out, quantiles(kept, keys, "_x", (0.25, 0.5, 0.75), nan=nan), keys)
    return out.select(*keys, "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("_sd")).alias("sd"), F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "min", "max")


def average_ranks(table: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Adds each value's rank among its keys' values, equal ones sharing the mean of their ranks."""
    counts = table.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = placed(counts, keys, value).select(*keys, value, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
    return table.join(ranks, [*keys, value])


def mann_whitney(table: DataFrame, keys: Sequence[str], value: str, side: str, first: object, second: object, exact: int = 8) -> DataFrame:
    """U of the first side, z and the two-sided p of each key: exact for untied sides of at most `exact` values, else normal with ties and continuity corrected."""
    both = table.where(F.col(side).isin(first, second) & F.col(value).isNotNull())
    counts = both.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), F.count(F.when(F.col(side) == F.lit(first), 1)).alias("_a"))
    ranked = placed(counts, keys, value).select(*keys, "_c", "_a", (F.col("_below") + (F.col("_c") + 1) / 2).alias("_rank"))
    c = F.col("_c").cast("double")
    out = ranked.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum(F.col("_c") - F.col("_a")).alias("n_b"), F.sum(F.col("_a") * F.col("_rank")).alias("_sum"), F.sum(c * c * c - c).alias("_ties"))
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    product = F.col("n_a") * F.col("n_b")
    u = F.col("_sum") - F.col("n_a") * (F.col("n_a") + 1) / 2
    spread = F.sqrt(product / 12.0 * (n + 1 - ratio(F.col("_ties"), n * (n - 1))))
    out = out.where("n_a > 0 AND n_b > 0").withColumn("u", u).withColumn("z", F.try_divide(F.greatest(F.abs(u - product / 2.0) - 0.5, F.lit(0.0)), spread))
    small = (F.col("n_a") <= exact) & (F.col("n_b") <= exact) & (F.col("_ties") == 0)
    return out.select(*keys, "n_a", "n_b", "u", "z", F.when(small, tails.mann_whitney_exact(F.when(small, F.col("u")), "n_a", "n_b")).otherwise(normal_p(F.col("z"))).alias("p"))


def signed_rank(pairs: DataFrame, keys: Sequence[str], first: str, second: str, least: int = 3, exact: int = 25) -> DataFrame:
    """Wilcoxon's signed ranks of paired values by key: differences of 0 are dropped; exact for few untied differences, else normal."""
    d = pairs.select(*keys, (F.col(first) - F.col(second)).alias("_d")).where("_d IS NOT NULL AND _d <> 0").withColumn("_size", F.abs("_d"))
    counts = d.groupBy(*keys, "_size").agg(F.count(F.lit(1)).alias("_c"), F.count(F.when(F.col("_d") > 0, 1)).alias("_up"))
    rank = F.col("_below") + (F.col("_c") + 1) / 2
    c = F.col("_c").cast("double")
    out = placed(counts, keys, "_size").select(*keys, "_c", "_up", rank.alias("_rank")).groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"), F.sum(c * c * c - c).alias("_ties"))
    n = F.col("n").cast("double")
    w = F.least(F.col("w_plus"), n * (n + 1) / 2 - F.col("w_plus"))
    z = (F.abs(F.col("w_plus") - n * (n + 1) / 4)) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    out = out.where(F.col("n") >= least).withColumn("w", w).withColumn("z", z)
    small = (F.col("n") <= exact) & (F.col("_ties") == 0)
    return out.select(*keys, "n", "w", "z", F.when(small, tails.signed_rank_exact(F.when(small, F.col("w")), "n")).otherwise(normal_p(F.col("z"))).alias("p"))


def fisher(table: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Adds odds_ratio (null where b * c is 0) and the two-sided exact p of the counts in four columns."""
    product = F.col(b).cast("double") * F.col(c)
    return table.withColumn("odds_ratio", F.when(product > 0, F.col(a).cast("double") * F.col(d) / product)).withColumn("p", tails.fisher_two_sided(a, b, c, d))


def two_by_two(table: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Counts of two conditions by key: both, only the first, only the second, neither."""
    count = lambda x, y: F.count_if(x & y)
    return table.groupBy(*keys).agg(count(first, second).alias("a"), count(first, ~second).alias("b"), count(~first, second).alias("c"), count(~first, ~second).alias("d"))


def enrichment(table: DataFrame, keys: Sequence[str], value: str, side: str, first: object, second: object, medians: DataFrame | None = None) -> DataFrame:
    """Cohen's d (pooled, 0 where the spread is), log2 fold change of shifted means, direction, and the odds ratio of being above the median of all rows with Fisher's p.

    The medians are those of the table's keys, or given by some of the keys.
    """
    both = table.where(F.col(value).isNotNull())
    mid = medians if medians is not None else quantiles(both, keys, value, [0.5]).select(*keys, F.col("_q")[0].alias("median"))
    is_a, is_b = F.col(side) == F.lit(first), F.col(side) == F.lit(second)
    on = [k for k in keys if k in mid.columns]
    v = F.col(value)
    up = v > F.col("median")
    count = lambda x: F.count_if(x)
    out = joined(both, mid, on).groupBy(*keys).agg(
        F.first("median").alias("median"), F.count(F.when(is_a, v)).alias("n_a"), F.count(F.when(is_b, v)).alias("n_b"), F.avg(F.when(is_a, v)).alias("mean_a"), F.avg(F.when(is_b, v)).alias("mean_b"),
        F.var_samp(F.when(is_a, v)).alias("_va"), F.var_samp(F.when(is_b, v)).alias("_vb"), count(is_a & up).alias("a"), count(is_a & ~up).alias("b"), count(is_b & up).alias("c"), count(is_b & ~up).alias("d"),
    )
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb")) / (F.col("n_a") + F.col("n_b") - 2))
    shift = F.abs(F.least("mean_a", "mean_b", "median")) + 1
    out = out.withColumn("cohens_d", F.when(pooled <= 1e-12, 0.0).otherwise(F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled)))
    out = out.withColumn("log2_fold", F.log2((F.col("mean_a") + shift) / (F.col("mean_b") + shift)))
    out = out.withColumn("direction", F.when(F.col("mean_a") > F.col("mean_b"), "up").when(F.col("mean_a") < F.col("mean_b"), "down").otherwise("same"))
    return fisher(out).select(*keys, "n_a", "n_b", "mean_a", "mean_b", "median", "cohens_d", "log2_fold", "direction", "odds_ratio", F.col("p").alias("fisher_p"))


def welch(table: DataFrame, keys: Sequence[str], value: str, side: str, first: object, second: object) -> DataFrame:
    """Welch's t, its degrees of freedom and two-sided p by key, for sides of two values at least."""
    is_a, v = F.col(side) == F.lit(first), F.col(value)
    out = table.where(F.col(side).isin(first, second) & v.isNotNull()).groupBy(*keys).agg(
        F.count(F.when(is_a, v)).alias("n_a"), F.count(F.when(~is_a, v)).alias("n_b"), F.avg(F.when(is_a, v)).alias("mean_a"), F.avg(F.when(~is_a, v)).alias("mean_b"), F.var_samp(F.when(is_a, v)).alias("_va"), F.var_samp(F.when(~is_a, v)).alias("_vb"),
    )
    sa, sb = F.col("_va") / F.col("n_a"), F.col("_vb") / F.col("n_b")
    out = out.where("n_a >= 2 AND n_b >= 2").withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb)))
    out = out.withColumn("df", F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)))
    return out.select(*keys, "n_a", "n_b", "t", "df", tails.t_two_sided("t", "df").alias("p"))


def spearman(table: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of the average ranks of rows that have both values, by key; NaN where one of them is constant, null for a single row."""
    both = table.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(both, keys, x, "_rx"), keys, y, "_ry")
    # Not corr, which divides by 0 where ranks are constant: an error in ANSI mode.
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    n = F.count(F.lit(1))
    return ranked.groupBy(*keys).agg(n.alias("n"), F.when(n > 1, F.coalesce(rho, F.lit(float("nan")))).alias("rho"))


def histogram(table: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts and densities in equal bins from the least to the largest value of each key; the last bin holds its upper edge."""
    kept = table.where(F.col(value).isNotNull())
    edges = kept.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width))).otherwise(F.lit(0))
    out = joined(kept, edges, keys).groupBy(*keys, number.cast("int").alias("bin"), "_lo", width.alias("_w"), "_n").agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("edge"), "n", F.try_divide(F.col("n"), F.col("_n") * F.col("_w")).alias("density"))


def ecdf(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of values at most x, for each distinct x of each key."""
    counts = table.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return placed(counts, keys, value).select(*keys, value, ((F.col("_below") + F.col("_c")) / F.col("_n")).alias("share"))


def box_stats(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the extreme values within 1.5 interquartile ranges) and the number of values beyond them."""
    kept = table.where(F.col(value).isNotNull())
    q = quantiles(kept, keys, value, (0.25, 0.5, 0.75)).select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return joined(kept, q, keys).groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("fliers"), F.count(F.lit(1)).alias("n"))


def clipped(table: DataFrame, value: str, share: float = 0.99) -> DataFrame:
    """The value's percentile, and how many values are at most it and above it."""
    top = quantiles(table, [], value, [share]).select(F.col("_q")[0].alias("limit"))
    return table.crossJoin(F.broadcast(top)).groupBy("limit").agg(F.count_if(F.col(value) <= F.col("limit")).alias("kept"), F.count_if(F.col(value) > F.col("limit")).alias("clipped"))


def throughput_outliers(table: DataFrame, value: str) -> DataFrame:
    """Adds the quartiles of all values and whether a value lies beyond 1.5 interquartile ranges of them."""
    q = quantiles(table, [], value, (0.25, 0.5, 0.75)).select(F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    return table.crossJoin(F.broadcast(q)).withColumn("outlier", (F.col(value) < F.col("q25") - reach) | (F.col(value) > F.col("q75") + reach))
