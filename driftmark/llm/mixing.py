"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to a budget of words, whole epochs first.

A source of size S and target T gives every document floor(T / S) times, then the documents of smallest key
-ln(u) / quality, u uniform from the document's id, until their sizes reach T - floor(T / S) * S.
Spark's range partitioning sorts the rows by source and key into chunks, which are summed one by one: no task holds a source.

What is taken follows from one row for each source: its epochs, the last key that fits and the one document that fills
the gap. The mixture is made from that row where the documents are read; their texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, running, shuffle_width

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most_epochs: float = 3) -> DataFrame:
    """sizes(source, source_size) with its target: the total shared by weight, no source above most_epochs times its size.

    Weights repeat along the sources in the order of their code points, null last. What a source can't take goes to the
    others by weight until none is above: with the sources in the order of their limit for each weight, the first k
    are at their limits and the others share the rest, for the smallest k at which none of the others is above.
    The table has a row for each source and is handled in one task.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    by_limit = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    earlier = by_limit.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    out = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * float(most_epochs)).withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    out = out.withColumn("_total", F.sum("source_size").over(whole).cast("double"))
    out = out.withColumn("_full", F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0)))
    out = out.withColumn("_open", F.sum("_weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)))
    out = out.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    # Along the order the level at which a source would be open only falls below its ratio once; that level holds for all open ones.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source", "_level"))).over(whole)
    out = out.withColumn("_level", level["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_weight") * F.col("_level")))
    return out.withColumn("target", target).drop("_weight", "_limit", "_ratio", "_total", "_full", "_open", "_level")


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the key (a string) and the seed alone."""
    hexes = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 12)
    return (F.conv(hexes, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def quality_weight(text: Column) -> Column:
    """Default quality weight, 0.1 to 1: the share of spaces is near that of ordinary prose in a good text.

    Null and empty texts weigh 0.1.
    """
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    share = spaces / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4 * F.abs(share - F.lit(0.16))), F.lit(0.1))


def _order(docs: DataFrame, id_col: str, text_col: str, quality: Column | None, seed: int) -> Column:
    """What documents are drawn by: the key, then the id, then a hash of the text."""
    weight = F.greatest(F.coalesce(quality if quality is not None else quality_weight(F.col(text_col)), F.lit(0.0)), F.lit(1e-9))
    key = -F.log(uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed)) / weight
    return F.struct(key.alias("key"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("text"))


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], most_epochs: float, quality: Column | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every row of docs without its text, with `fits`; and for each source what is taken of it:

    epochs; `upto`, the last order that fits, and how many rows of that order fit (`n_upto`) and are there (`m_upto`); `last`, the
    order that fills the gap.
    """
    spark = docs.sparkSession
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _order(docs, id_col, text_col, quality, seed).alias("order"), F.monotonically_increasing_id().alias("row"))
    light = cut(light)  # the texts are read once
    chunks = max(shuffle_width(spark), light.count() // 200_000)
    light = cut(light.repartitionByRange(chunks, F.col("source").asc_nulls_last(), F.col("order"), F.col("row")).withColumn("chunk", F.spark_partition_id()))
    plan = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = cut(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of"))
    rows = running(light, ["source"], ["chunk"], [F.col("order"), F.col("row")], F.col("size"), "before")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    drawn = (F.col("size") > 0) & (F.col("epochs") < most_epochs)
    rows = cut(rows.withColumn("fits", drawn & (F.col("before") + F.col("size") <= F.col("rest"))).drop("of", "before", "chunk"))
    got = rows.groupBy(F.col("source").alias("of")).agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("sum"), F.max(F.when(F.col("fits"), F.col("order"))).alias("upto"))
    got = cut(plan.join(got, plan["of"].eqNullSafe(got["of"])).drop(got["of"]).withColumn("gap", F.col("rest") - F.col("sum")))
    near = F.abs(F.col("gap") - F.col("size"))
    each = rows.select("source", "size", "order", "fits").join(got.select("of", "epochs", "gap", "upto"), F.col("source").eqNullSafe(F.col("of")))
    own = F.col("order").eqNullSafe(F.col("upto")) & (F.col("size") > 0)
    fills = drawn & ~F.col("fits") & (near < F.col("gap"))
    more = each.groupBy("of").agg(F.count(F.when(own & F.col("fits"), 1)).alias("n_upto"), F.count(F.when(own, 1)).alias("m_upto"), F.min(F.when(fills, F.struct(near.alias("near"), "order")))["order"].alias("last"))
    return rows, cut(got.join(more, got["of"].eqNullSafe(more["of"])).drop(more["of"]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most_epochs: float = 3, quality: Column | None = None, seed: int = 11) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words), copies.

    A document is taken whole. Those of smallest key are drawn while their sum stays within the budget; the gap that
    is left goes to the one other document whose size is nearest to it, if that brings the sum nearer. Null sources form one source. Null and empty texts have size 0
    and are never drawn beyond the whole epochs. Quality weights of null, 0 or less count as 1e-9. Equal keys go by id,
    then by a hash of the text. Repeated rows are documents of their own. An empty table gives an empty table. Sources
    are expected to be few: the table of targets, a row for each, is handled in one task.
    """
    rows, plan = _decided(docs, id_col, text_col, source_col, weights, most_epochs, quality, seed)
    plan = plan.select("of", "last")
    last = F.col("order").eqNullSafe(F.col("last")) & ~F.col("fits") & (F.col("size") > 0)
    mixed = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    # Of repeated rows one fills the gap.
    one = mixed.where(last).groupBy("source").agg(F.min("row").alias("one")).select(F.col("source").alias("of_"), "one")
    mixed = mixed.join(one, F.col("source").eqNullSafe(F.col("of_")), "left")
    copies = (F.col("epochs") + F.when(F.col("fits") | F.coalesce(F.col("row") == F.col("one"), F.lit(False)), 1).otherwise(0)).cast("int")
    return mixed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most_epochs: float = 3, quality: Column | None = None, seed: int = 11) -> DataFrame:
    """The mixture itself: each row of docs as many times as `mix` takes it, with all its columns.

    Rows that agree in id and text are drawn in the order of their places in docs where not all of them fit. Nulls, empty
    texts, ties and empty tables are as in `mix`; columns may have any names.
    """
    _, plan = _decided(docs, id_col, text_col, source_col, weights, most_epochs, quality, seed)
    names = fresh(docs, "order", "of", "epochs", "upto", "last", "n_upto", "m_upto", "copies", "part", "row", "place")
    order, of, epochs, upto, last, n_upto, m_upto, copies, part, row, place = names
    plan = plan.select(*[F.col(c).alias(n) for c, n in zip(("of", "epochs", "upto", "last", "n_upto", "m_upto"), (of, epochs, upto, last, n_upto, m_upto))])
    # A row for each source: small, so that the planner sends it to the tasks.
    marked = docs.withColumn(order, _order(docs, id_col, text_col, quality, seed)).join(plan, F.col(source_col).eqNullSafe(F.col(of)))
    words = F.coalesce(F.regexp_like(text_col, F.lit(WORDS)), F.lit(False))
    at_end, at_last = F.col(order).eqNullSafe(F.col(upto)), F.col(order).eqNullSafe(F.col(last))
    below = F.coalesce(F.col(order) < F.col(upto), F.lit(False)) & ~at_last
    # Rows of the last order that fits, or of the one that fills the gap, are all taken, or else numbered: those are repeated rows.
    told = F.when(at_end & at_last, F.col(n_upto) + 1).when(at_end, F.col(n_upto)).when(at_last, F.lit(1))
    whole = at_end & ~at_last & (F.col(n_upto) == F.col(m_upto))
    extra = lambda yes: (F.col(epochs) + F.when(words & yes, 1).otherwise(0)).cast("int")
    sure = marked.where(~(at_end | at_last) | whole).withColumn(copies, extra(below | whole))
    rest = marked.where((at_end | at_last) & ~whole).withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id())
    rest = running(cut(rest), [of, order], [part], [F.col(row)], F.lit(1), place)
    rest = rest.withColumn(copies, extra(F.col(place) < told))
    taken = sure.select(*docs.columns, copies).unionByName(rest.select(*docs.columns, copies)).where(F.col(copies) > 0)
    return taken.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
