"""The pipeline and the registered queries over the smallest tables."""

import numpy as np

import corpus_pipeline
from driftmark.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_hand_on_their_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
    kept = docs.count()
    assert 0.5 * before < kept < before and docs.select("doc_id").distinct().count() == kept


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, DATA).groupBy("shard").count().collect()
    assert len(out) == 24 and max(r["count"] for r in out) - min(r["count"] for r in out) <= 1


def test_all_are_registered():
    names = list(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and set(queries.oracle_sql()) <= set(names)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, same string, n long, number long, size long, key string"


def hostile(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that are called like those of the stages."""
    words = lambda i, n: " ".join(f"w{x}" for x in np.random.default_rng(i + 1000 * n).integers(0, 3000, n))
    texts = [(i, words(i, 40)) for i in range(60)] + [(60, words(0, 40)), (60, words(0, 40)), (61, None), (62, ""), (None, words(3, 40)), (None, None), (63, words(5, 40_000)), (64, " \n\t "), (60, words(9, 40))]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 1, "x", 2, None, 3, None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA).repartition(3)


def test_stages_on_hostile_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(None, 1, 0), (41, None, 0), (999, 0, 0), (42, 5, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = hostile(spark)
    leaked = docs.where("doc_id = 7").first().text
    spark.createDataFrame([(1, leaked), (None, "no id"), (2, None), (3, ""), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        path = f"{tmp_path}/{stage.__name__}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        if stage is corpus_pipeline.STAGES[-1][1]:
            sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
            assert out.count() == docs.count() and max(sizes) - min(sizes) <= 1
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in out.select("doc_id").collect())
        if stage is corpus_pipeline.keep_one_of_each:
            # 60 has a copy of 0 twice and another text; the row of a null id is a copy of 3; 61, 62 and the other null one are empty.
            assert len(ids) == len(set(ids)) and 60 not in ids and -1 not in ids and {0, 3, 9, 61, 63, 64} <= set(ids) and 62 not in ids
        elif stage is corpus_pipeline.drop_leaks:
            assert 7 not in ids and len(ids) == docs.count() - 1
        elif stage is corpus_pipeline.keep_good:
            assert len(ids) <= before
        docs = out
