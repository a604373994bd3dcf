"""Feature tables: imputation, scaling, batch effects and their correction."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions import tails
from driftmark.functions.scalars import finite
from driftmark.operators import stats

PAIR = Sequence[str]


def impute_median(table: DataFrame, columns: PAIR) -> DataFrame:
    """Missing and non-finite values of each column become its median; 0 where all are missing."""
    clean = table.select(*[c for c in table.columns if c not in columns], *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    medians = _quantiles(clean, columns, [0.5])
    return clean.select(*[c for c in table.columns if c not in columns], *[F.coalesce(F.col(c), F.lit(float(medians[c][0] if c in medians else 0))).alias(c) for c in columns])


def _quantiles(table: DataFrame, columns: PAIR, shares: Sequence[float]) -> dict[str, list[float]]:
    """Percentiles of each column that has values: a row for each column."""
    return {r.feature: r["_q"] for r in stats.quantiles(long(table, [], columns), ["feature"], "value", shares).collect()}


def _apply(table: DataFrame, columns: PAIR, how) -> DataFrame:
    return table.select(*[c for c in table.columns if c not in columns], *[F.coalesce(finite(how(c)), F.lit(0.0)).alias(c) for c in columns])


def zscore(table: DataFrame, columns: PAIR, ddof: int = 0) -> DataFrame:
    """Values less their column's mean over its deviation; a deviation below 1e-12 counts as 1, what isn't finite becomes 0."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    got = table.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[sd(c).alias(f"s_{c}") for c in columns]).first()
    scale = {c: (got[f"s_{c}"] or 0.0) for c in columns}
    return _apply(table, columns, lambda c: (F.col(c) - F.lit(got[f"m_{c}"])) / F.lit(scale[c] if scale[c] >= 1e-12 else 1.0))


def robust(table: DataFrame, columns: PAIR) -> DataFrame:
    """Values less the median over the interquartile range."""
    none = [0.0, 0.0, 0.0]
    got = {c: none for c in columns} | _quantiles(table, columns, (0.25, 0.5, 0.75))
    return _apply(table, columns, lambda c: (F.col(c) - F.lit(got[c][1])) / F.lit(got[c][2] - got[c][0] if got[c][2] - got[c][0] >= 1e-12 else 1.0))


def minmax(table: DataFrame, columns: PAIR) -> DataFrame:
    """Values from 0 to 1 between the column's least and largest; a column without values becomes 0."""
    got = table.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    span = lambda c: (got[f"b_{c}"] or 0.0) - (got[f"a_{c}"] or 0.0)
    return _apply(table, columns, lambda c: (F.col(c) - F.lit(got[f"a_{c}"])) / F.lit(span(c) if span(c) >= 1e-12 else 1.0))


def zscore_by_batch(table: DataFrame, columns: PAIR, batch: str) -> DataFrame:
    """z-scores inside each batch of two rows at least, then over all rows."""
    w = W.partitionBy(batch)
    one = lambda c: F.when(F.count(F.lit(1)).over(w) < 2, F.col(c)).otherwise((F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) < 1e-12, 1.0).otherwise(F.stddev_pop(c).over(w)))
    return zscore(table.select(*[c for c in table.columns if c not in columns], *[one(c).alias(c) for c in columns]), columns)


def long(table: DataFrame, keys: PAIR, columns: PAIR) -> DataFrame:
    """One row for each row and column: keys, feature, value."""
    return table.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "feature", "value")


def effects(table: DataFrame, batch: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Share of each feature's variance between batches (eta squared) with the F test's p.

    Batches of fewer than two values don't count between, but in the total. With fewer than 3 values or no variance
    the share is 0 and p null.
    """
    v = F.col(value)
    sums = table.where(v.isNotNull()).groupBy(feature, batch).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    whole = W.partitionBy(feature)
    grand = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    apart = F.col("n") * F.pow(F.col("m") - grand, F.lit(2))
    out = sums.select(feature, "n", apart.alias("apart"), (F.col("n") * F.col("v")).alias("inside"), (F.col("n") >= 2).alias("counts"))
    counts = F.col("counts")
    out = out.groupBy(feature).agg(
        F.sum(F.col("apart") + F.col("inside")).alias("sst"), F.coalesce(F.sum(F.when(counts, F.col("apart"))), F.lit(0.0)).alias("ssb"),
        F.count(F.when(counts, 1)).alias("groups"), F.sum(F.when(counts, F.col("n"))).alias("m"), F.sum("n").alias("n"),
    )
    flat = (F.col("n") < 3) | (F.col("sst") < 1e-12)
    eta = F.when(flat, 0.0).otherwise(F.least(F.lit(1.0), F.col("ssb") / F.col("sst")))
    value_f = F.try_divide(F.col("ssb") / (F.col("groups") - 1), (F.col("sst") - F.col("ssb")) / (F.col("m") - F.col("groups")))
    ok = ~flat & (F.col("groups") >= 2) & (F.col("m") > F.col("groups"))
    out = out.withColumn("eta_squared", eta).withColumn("f", F.when(ok, value_f))
    return out.select(feature, "n", "groups", "eta_squared", "f", tails.f_upper("f", F.col("groups") - 1, F.col("m") - F.col("groups")).alias("p"))


def effect_summary(shares: DataFrame, value: str = "eta_squared") -> DataFrame:
    """Mean, median and largest share, and how many features are above 0.1 and 0.25."""
    return shares.agg(F.count(F.lit(1)).alias("features"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("max"), F.count_if(F.col(value) > 0.1).alias("above_10"), F.count_if(F.col(value) > 0.25).alias("above_25"))


def largest_effects(shares: DataFrame, most: int = 30, value: str = "eta_squared") -> DataFrame:
    """The `most` features of the largest shares (ties: by name), numbered from 1."""
    top = shares.orderBy(F.desc_nulls_last(value), "feature").limit(most)  # few rows from here on
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last(value), "feature")).cast("long"))


def effect_change(before: DataFrame, after: DataFrame, value: str = "eta_squared") -> DataFrame:
    """Shares before and after a correction, 0 where missing after, and the reduction in percent."""
    post = after.select("feature", F.col(value).alias("after"))
    out = before.select("feature", F.col(value).alias("before")).join(post, "feature", "left").withColumn("after", F.coalesce("after", F.lit(0.0)))
    return out.withColumn("reduction_pct", F.try_divide(100 * (F.col("before") - F.col("after")), F.col("before")))


def batch_centroids(table: DataFrame, columns: PAIR, batch: str) -> DataFrame:
    """Mean of each batch in z-scored columns (sample deviation)."""
    return zscore(table, columns, ddof=1).groupBy(batch).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def stratified(table: DataFrame, key: str, batch: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows, as many of each batch (two at least), those of the smallest md5 of their key and the seed."""
    batches = table.select(batch).distinct().count()
    each = max(2, most // max(1, batches))
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    order = F.row_number().over(W.partitionBy(batch).orderBy(mark, key))
    return table.withColumn("_r", order).where(F.col("_r") <= each).drop("_r").orderBy(mark, key).limit(most)


def combat(table: DataFrame, keys: PAIR, columns: PAIR, batch: str, rounds: int = 500, close: float = 1e-4) -> DataFrame:
    """Empirical-Bayes correction of additive and multiplicative batch effects, without covariates.

    Counts, means and variances by batch and feature are all that the estimates need; they are batches times
    features rows, and the iterations run on them in the driver. Fewer than two batches leave the table as it is, and so does a column of which some
    batch has no value. A missing value stays missing.
    """
    import numpy as np

    asked = list(columns)
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("v", F.var_pop))]
    got = table.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), *aggs).orderBy(batch).collect()  # a row for each batch
    whole = [c for c in columns if all(r[f"m_{c}"] is not None for r in got)]
    if len(got) < 2 or not whole:
        return table
    left, columns = [c for c in columns if c not in whole], whole
    n = np.array([r.n for r in got], float)[:, None]
    mean = np.array([[r[f"m_{c}"] for c in columns] for r in got])
    var = np.array([[r[f"v_{c}"] for c in columns] for r in got])
    grand = (n * mean).sum(0) / n.sum()
    within = (n * var).sum(0) / max(n.sum() - len(got), 1)
    spread = np.sqrt(np.where(within < 1e-12, 1.0, within))
    zs = n * (mean - grand) / spread
    zq = n * (var + (mean - grand) ** 2) / spread**2
    gamma = zs / n
    delta = np.where(n > 1, (zq - zs * zs / n) / np.maximum(n - 1, 1), 1.0)
    delta = np.where(delta < 1e-12, 1.0, delta)
    centre, tau = gamma.mean(1, keepdims=True), gamma.var(1, keepdims=True)
    m, v = delta.mean(1, keepdims=True), delta.var(1, keepdims=True)
    v = np.where(v < 1e-12, 1e-12, v)
    shape, rate = (2 * v + m * m) / v, (m * v + m**3) / v
    g, d = gamma.copy(), delta.copy()
    for _ in range(rounds):
        g2 = (n * tau * gamma + d * centre) / (n * tau + d)
        d2 = (rate + 0.5 * (zq - 2 * g2 * zs + n * g2 * g2)) / (n / 2 + shape - 1)
        moved = max(np.max(np.abs(g2 - g) / np.maximum(np.abs(g), 1e-12)), np.max(np.abs(d2 - d) / np.maximum(np.abs(d), 1e-12)))
        g, d = g2, d2
        if moved < close:
            break
    rows = [(r[batch], *[float(x) for j in range(len(columns)) for x in (g[i, j], np.sqrt(d[i, j]))]) for i, r in enumerate(got)]
    schema = f"`_b` {dict(table.dtypes)[batch]}, " + ", ".join(f"`_g_{c}` double, `_d_{c}` double" for c in columns)
    star = F.broadcast(table.sparkSession.createDataFrame(rows, schema))

    def fixed(j: int, c: str) -> Column:
        z = (F.col(c) - F.lit(float(grand[j]))) / F.lit(float(spread[j]))
        return ((z - F.col(f"_g_{c}")) / F.col(f"_d_{c}") * F.lit(float(spread[j])) + F.lit(float(grand[j]))).alias(c)

    kept = [c for c in table.columns if c not in columns]
    return table.join(star, F.col(batch).eqNullSafe(F.col("_b"))).select(*kept, *[fixed(j, c) for j, c in enumerate(columns)]).select(*[c for c in kept if c not in left], *asked)


def pca(table: DataFrame, keys: PAIR, columns: PAIR, k: int = 2) -> DataFrame:
    """The first k principal components of z-scored columns (sample deviation); of each, the largest loading is positive."""
    import numpy as np
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scaled = zscore(table, columns, ddof=1)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(scaled)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vectors)
    axes = np.array(model.pc.toArray())
    signs = [float(np.sign(axes[np.argmax(np.abs(axes[:, i])), i]) or 1.0) for i in range(k)]
    pc = vector_to_array("_pc")
    return model.transform(vectors).select(*keys, *[(pc[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])


def _scrambled(x):
    """A bijective 64-bit scrambler (published mixing constants)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _borders(hashes: DataFrame, ends: list[int], marks, parts: int, few: int):
    """For each permutation and each of `ends` the hash value of that rank, as an array: exact order statistics of all permutations from counts.

    hashes: h, one for each row; marks: a number for each permutation. Around the place where a rank should lie, hashes are counted in `parts` parts, and the part
    that holds the rank is counted again, until it holds at most `few` rows; those are collected. What is shuffled and collected is a row for each permutation, rank and part.
    """
    import numpy as np
    import pyarrow as pa

    rows = hashes.count()
    perms, ranks = len(marks), np.array(ends, dtype=np.int64)
    share = ranks / rows
    reach = 6 * np.sqrt(share * (1 - share) / rows) + 4 / rows
    whole = 2.0**64
    low = np.tile((np.clip(share - reach, 0, 1) * (whole - 2048)).astype(np.uint64), (perms, 1))
    high = np.tile((np.clip(share + reach, 0, 1) * (whole - 2048)).astype(np.uint64), (perms, 1))

    def edges_of(low, high):
        width = (high - low) // np.uint64(parts) + np.uint64(1)
        steps = np.arange(parts + 1, dtype=np.uint64)
        out = low[:, :, None] + np.minimum(steps * width[:, :, None], (high - low)[:, :, None])
        return out

    while True:
        edges = edges_of(low, high)

        def count(batches, edges=edges):
            total = np.zeros(edges.shape, dtype=np.int64)
            for batch in batches:
                h = batch.column("h").to_numpy().view(np.uint64)
                for p in range(perms):
                    total[p] += np.searchsorted(np.sort(_scrambled(h ^ marks[p])), edges[p], "left")
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

        below = np.zeros(edges.size, dtype=np.int64)
        for r in hashes.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each permutation, rank and part
            below[r.at] = r.n
        below = below.reshape(edges.shape)
        missed = (below[:, :, 0] >= ranks) | (below[:, :, -1] < ranks)  # not in the window at all
        part = np.minimum((below < ranks[None, :, None]).sum(axis=2) - 1, parts - 1).clip(0)
        pick = lambda x, k: np.take_along_axis(x, k[:, :, None], 2)[:, :, 0]
        low, high = pick(edges, part), pick(edges, part + 1)
        low[missed], high[missed] = 0, np.uint64((1 << 64) - 2048)
        left, held = pick(below, part), pick(below, part + 1) - pick(below, part)
        if not missed.any() and ((held <= few) | (high - low <= 1)).all():
            break

    def gather(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            out = [[], [], []]
            for p in range(perms):
                x = np.sort(_scrambled(h ^ marks[p]))
                for j, (a, b) in enumerate(zip(np.searchsorted(x, low[p], "left").tolist(), np.searchsorted(x, high[p], "left").tolist())):
                    if b > a:
                        out[0].append(np.full(b - a, p))
                        out[1].append(np.full(b - a, j))
                        out[2].append(x[a:b].view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["p", "j", "x"])

    found: dict[tuple[int, int], list[int]] = {}
    for r in hashes.mapInArrow(gather, "p long, j long, x long").collect():  # at most `few` rows for each permutation and rank
        found.setdefault((r.p, r.j), []).append(r.x & ((1 << 64) - 1))
    return np.array([[sorted(found[p, j])[int(ranks[j] - left[p, j]) - 1] for j in range(len(ends))] for p in range(perms)], dtype=np.uint64).reshape(perms, len(ends))


def permanova(table: DataFrame, key: str, columns: PAIR, batch: str, permutations: int = 499, seed: int = 42, parts: int = 32, few: int = 16) -> DataFrame:
    """Multivariate analysis of variance by permutation: r2, pseudo_f and p of the batches, on z-scored columns.

    All rows count. Squared distances are never formed: the sum within groups is the total less the sum of n times the squared
    mean. A permutation orders the rows by a hash of their key and deals the labels out in that order, each to as many rows as it has. The hashes at the borders
    between labels are found first, from counts; then one pass adds each row to a sum for each permutation and label inside its task, and only those sums are shuffled. Rows of
    equal keys have the same label in a permutation. Batches have a row each in the driver. One batch, or an empty table, gives r2 and null for what can't be told.
    """
    import numpy as np
    import pyarrow as pa

    z = zscore(table, columns, ddof=1)
    spark = table.sparkSession
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]]
    own = z.groupBy(F.col(batch).alias("_label")).agg(*sums).orderBy(F.col("_label").asc_nulls_first()).collect()  # a row for each batch
    sizes = [r.n for r in own]
    rows = z.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    marks = _scrambled(np.arange(1, permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    width = len(columns)
    made = [(0, i, r.n, *[float(r[c]) for c in columns]) for i, r in enumerate(own)]
    schema = ", ".join(["perm long, label long, n long", *[f"`{c}` double" for c in columns]])
    groups = spark.createDataFrame(made, schema)
    if len(sizes) > 1:
        borders = _borders(rows.select("h"), np.cumsum(sizes)[:-1].tolist(), marks, parts, few)

        def deal(batches):
            total = np.zeros((permutations, len(sizes), width + 1))
            for b in batches:
                h = b.column("h").to_numpy().view(np.uint64)
                v = np.asarray(b.column("v").flatten()).reshape(-1, width)
                for p in range(permutations):
                    label = np.searchsorted(borders[p], _scrambled(h ^ marks[p]), "left")
                    total[p, :, 0] += np.bincount(label, minlength=len(sizes))
                    for c in range(width):
                        total[p, :, c + 1] += np.bincount(label, v[:, c], len(sizes))
            p, label = (x.ravel() for x in np.indices(total.shape[:2]))
            flat = total.reshape(-1, width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(p + 1), pa.array(label), pa.array(flat[:, 0].astype(np.int64)), *[pa.array(flat[:, c + 1]) for c in range(width)]], names=["perm", "label", "n", *columns])

        groups = groups.unionByName(rows.mapInArrow(deal, schema).groupBy("perm", "label").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]))
    between = groups.groupBy("perm").agg(F.sum(F.try_divide(sum(F.col(c) * F.col(c) for c in columns), F.col("n"))).alias("ssb"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    total = z.agg(F.sum(sum(F.col(c) * F.col(c) for c in columns)).alias("sst"))
    f = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("sst") - F.col("ssb"), F.col("n") - F.col("k")))
    stats_ = between.crossJoin(F.broadcast(total)).withColumn("pseudo_f", f).withColumn("r2", F.try_divide(F.col("ssb"), F.col("sst")))
    seen = stats_.where("perm = 0").select(F.col("pseudo_f").alias("seen"), F.col("r2").alias("_r2"))
    dealt = stats_.where("perm > 0").select("perm", "pseudo_f")
    compared = seen.join(dealt, F.lit(True), "left").groupBy("seen", "_r2").agg(F.count_if(F.col("pseudo_f") >= F.col("seen")).alias("as_large"), F.count("perm").alias("of"))
    return compared.select(F.col("_r2").alias("r2"), F.col("seen").alias("pseudo_f"), F.when(F.col("of") > 0, (F.col("as_large") + 1) / (F.col("of") + 1)).alias("p"))
