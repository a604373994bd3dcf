"""Session helpers that several operators share: written tables, range buckets, ranks and runs of rows."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session of one machine gets a fresh local one; any other raises ValueError."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own, not yet there, in the folder that the driver and all executors share."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that the driver and all executors share and read again.

    Unlike a checkpoint, a table that is read carries none of the constraints of the plan that made it; in a loop those
    grow with every round.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The table of a loop: each round writes it anew, and the round before is removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "round")
        df.write.parquet(path)
        if self.path:
            remove(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put on until df has no column of the name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most buckets - 1 increasing cut points that deal the values of an integer column out evenly."""
    if buckets < 2:
        return []
    points = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, points, 10 * buckets).alias("p")).first().p
    return sorted({int(x) for x in found or []})


def range_bucket(value: Column, bounds: Sequence[int]) -> Column:
    """Number of bounds that are at most value: a two-level search, so that a row costs the root of their number.

    Null values go to bucket 0.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    heads, table = longs([b[0] for b in blocks]), F.array(*[longs(b) for b in blocks])
    block = F.size(F.filter(heads, lambda x: x <= value))
    inner = F.size(F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda x: x <= value))
    return F.when(value.isNull() | (block < 1), F.lit(0)).otherwise((block - 1) * step + inner)


def running(df: DataFrame, parts: Sequence[str], chunk: Sequence[str], order: Sequence[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of amount over the earlier rows of the same part: sums by chunk first, then a window inside each chunk.

    Chunks must come in the order of the rows. No task sees more of a part than one of its chunks and the sums.
    """
    keys = [*parts, *chunk]
    amount_, inside, earlier = fresh(df, "_amount", "_inside", "_earlier")
    by_chunk = df.groupBy(*keys).agg(F.sum(amount).alias(amount_))
    before = F.sum(amount_).over(W.partitionBy(*parts).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1))
    named = fresh(df, *[f"_k{i}" for i in range(len(keys))])
    by_chunk = by_chunk.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.coalesce(before, F.lit(0)).alias(earlier))
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # Dealt out by part and chunk, also where the rows lie dealt out by the part already.
    dealt = df.repartition(*keys).withColumn(inside, F.coalesce(F.sum(amount).over(window), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)]
    return dealt.join(by_chunk, on, "left").withColumn(name, F.col(earlier) + F.col(inside)).drop(inside, earlier, *named)


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a sorted stream of batches as one table for each run of equal keys."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts would pass `most` bytes, to bound what is worked on at a time."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) of one type as rows (node, root), root the smallest node of the component.

    Alternates large-star and small-star steps until the edges stop changing: every step only groups edges by a node.
    Edges with a null end are left out.
    """
    spark = edges.sparkSession
    rounds, lows = Rounds(spark), Rounds(spark)
    now = rounds.put(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    said = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join's shuffle is its own and Spark can split it at a node with very many edges.
        least = lows.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        now = rounds.put(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if said == (new.n, new.s):
            break
        said = (new.n, new.s)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
