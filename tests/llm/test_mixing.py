"""Mixing with rows that are repeated very often."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from statledger.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    one = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "concat('s', id % 3) as source")
    hot = spark.range(3000).selectExpr("7777777 as doc_id", "if(id % 2 = 0, 'three little words', 'three other words') as text", "'s1' as source")
    none = spark.range(40).selectExpr("cast(null as long) as doc_id", "'a word or two' as text", "cast(null as string) as source")
    return one.union(hot).union(none).repartition(9)


def test_repeated_rows_are_settled_as_one(docs):
    planned = mixing.plan(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    rows = planned.collect()
    assert len(rows) == 6002 and sum(r["n"] for r in rows) == 9040
    hot = next(r for r in rows if r["doc_id"] == 7777777)
    rate = hot["target"] / hot["source_size"]
    assert abs(hot["whole"] * hot["n"] + hot["more"] - rate * hot["n"]) < 1
    taken = mixing.mix(docs).collect()
    assert len(taken) == 9040
    by_source = mixing.mix(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] + 5 for r in by_source) and len(by_source) == 4


def test_mixed_rows_are_those_of_the_plan(docs):
    rows = mixing.mixed(docs).groupBy("doc_id", "text", "copy_no").count().collect()
    planned = {r["doc_id"]: r for r in mixing.plan(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    taken = Counter()
    for r in rows:
        taken[r["doc_id"]] += r["count"]
    for doc_id, r in planned.items():
        assert taken[doc_id] == r["whole"] * r["n"] + r["more"], r
    hot = [r for r in rows if r["doc_id"] == 7777777]
    assert {r["text"] for r in hot} == {"three little words", "three other words"}


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", " a b\x0b\x0cc\r\n", "a b c", "\x1ca b\x1f", "é  日本  x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [0, 0, 0, 1, 3, 2, 2, 3]
