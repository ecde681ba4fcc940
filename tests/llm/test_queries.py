"""Registered queries with SQL equivalents, and the pipeline stage by stage on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybrook.llm import near_duplicates, queries, quality

from ..conftest import SF
from ..oracle import connect, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    good = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    first = corpus_pipeline.keep_quality(spark, docs, SF).cache()
    assert first.columns == names and {r["doc_id"] for r in first.select("doc_id").collect()} == good
    second = corpus_pipeline.keep_one_of_each(spark, first, SF).cache()
    groups = {r["class_id"] for r in near_duplicates.near_duplicates(first).collect()}
    assert second.columns == names and {r["doc_id"] for r in second.select("doc_id").collect()} == groups
    third = corpus_pipeline.drop_repeated_strings(spark, second, SF).cache()
    assert third.columns == names and third.count() == second.count()
    fourth = corpus_pipeline.drop_contaminated(spark, third, SF).cache()
    assert fourth.columns == names
    last = corpus_pipeline.pack(spark, fourth, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in fourth.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == last.count()


CLASHING = "doc_id__ text__ text_is_null__ key_ key w sig bands node own x y g tk n z spans null text_ kept_0__ kept_1__ score held_out predicted hits h quality component salt_ salts_ least copies wanted_w other part name".split()


@pytest.mark.parametrize("number", range(4))
def test_stage_with_odd_rows(spark, number):
    """Columns named like internal ones, null and repeated ids, null and empty texts, a text of 3 MB: rows stay whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(None, "Null id of its own words"), (None, "Null id of its own words"), (None, None), (7, None), (7, ""), (8, "many words " * 270_000)], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("doc", F.concat_ws("/", F.col("doc_id"), F.xxhash64("text")))
    docs = docs.withColumns({c: F.concat(F.lit(c + ":"), "doc") for c in CLASHING})
    stage = corpus_pipeline.STAGES[number][1]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{r['doc']}" for r in rows for c in CLASHING)
    ids = {r["doc"]: (r["doc_id"], r["text"]) for r in docs.select("doc", "doc_id", "text").collect()}
    assert all(r["doc_id"] == ids[r["doc"]][0] and (number == 2 or r["text"] == ids[r["doc"]][1]) for r in rows)
    if number == 2:
        assert len(rows) == docs.count()
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0
