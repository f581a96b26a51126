"""The stages of the pipeline on a small table, each against what its operator must do."""

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tidefold.llm import queries, substring_dedup



def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, data).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == columns and after.dtypes == docs.dtypes
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        assert set(new) <= set(old) and 0 < len(new) and after.count() == len(new)
        if name == "repeated passages":
            want = substring_dedup.brute_force(list(old.items()))
            assert set(new) == set(old)
            for i, t in new.items():
                assert len(t.encode().split()) == want[i][0] - want[i][1]
        else:
            assert all(old[i] == t for i, t in new.items())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(new)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", 7), (2, "", "en", 7), (None, "some words " * 30, "en", 7), (3, "plain words of a text " * 2, None, 7), (3, "plain words of a text " * 2, None, 7)]
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            n = out.count()
            if name != "packing":
                assert out.columns == d.columns and all(r.kept == 7 for r in out.collect())
            if name == "near duplicates" and d is docs:
                assert n == 4
            if name == "repeated passages":
                assert n == d.count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    out = queries.queries()[name](spark, data)
    rows = out.count()
    assert rows > 0
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("pages", "documents"):
            con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
        want = con.sql(queries.oracle_sql()[name]).df()
        got = out.toPandas()
        key = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False, name=None)))
        assert key(got) == key(want)


def test_every_document_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
    for name in ("op3_suffix_tree_lm", "op4_quality_classifier", "op5_substring_dedup", "op6_near_dedup", "op9_pieces", "op10_quality_rules"):
        got = queries.queries()[name](spark, data).select("doc_id")
        assert got.count() == docs.count() == got.join(docs, "doc_id").agg(F.count_distinct("doc_id")).first()[0], name
