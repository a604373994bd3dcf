"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), reads all that its predecessor kept and returns a DataFrame.

All but the last return the columns of documents. Each stage's result is written as Parquet before the next one reads it,
so that an executor lost in a stage repeats that stage's tasks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmark.llm import decontaminate, mixing, ngram_join, quality, sharding
from driftmark.llm.common import remove, shared_path

#: No SQL: the first stage trains a model, and the later ones work on what it keeps.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a classifier trained on the labels of docs rejects.

    Null and empty texts are scored like others. Without labels, and of an empty table, all rows stay. Equal texts have equal scores, so that
    repeated rows stay or go together; a score of the border itself stays. Labels of a null id or of no document, and ones other than 0 and 1, teach nothing. Columns may have any
    names, and all are kept.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_rows(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id.

    Null and empty texts are one group. Repeated ids with different texts are different documents. Of rows that agree in id and text, that of the least md5 of its JSON
    stays; a row of a null id stays only where its group has no other. An empty table gives an empty table. Columns may have any names, and all are kept.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none and stay, whatever their id. Repeated rows stay or go together. Items of a null id, and of null or empty texts, are not looked for. Ties don't
    matter here: one item is enough. An empty table gives an empty table, and without items all rows stay. Columns may have any names, and all are kept.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and draws documents until the sources have their target weights.

    Null sources are one source. Documents without words are in it only as often as their source is taken whole. Equal keys are ordered by the documents' ids; rows that agree in id
    and text, of which not all fit, by their places. An empty table gives an empty table. Columns may have any names, and all are kept.
    """
    return mixing.mixed_rows(docs)


def deal_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row of the mixture into one of 24 shards, copies of a text together where the quotas allow.

    Null ids, null texts and repeated rows are rows like others; repeated rows are copies of each other. Equal wishes are ordered by a hash of the text. An empty table gives an
    empty table. Only the id and the text are read: the result has the columns of `sharding.shard`, and none of those of docs besides doc_id.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", deal_out),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is removed once the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
