"""The corpus pipeline itself: each stage over what the one before it kept, held against its operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statledger.llm import decontaminate, mixing, pii, simhash, toxicity
from statledger.llm.tables import load

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage, written and read again as run() does."""
    docs, out = load(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def ids(docs):
    return sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_stages_stand_in_their_order(steps):
    assert list(steps) == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [after.columns for _, after in steps.values()] == [columns] * 4 + [columns + ["copy_no"]]


def test_toxic_documents_go_and_no_others(spark, steps):
    before, after = steps["toxicity"]
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.score(before, load(spark, SMALL, "labels")).collect()}
    assert ids(after) == sorted(k for k, bad in judged.items() if not bad) and len(judged) >= len(ids(after)) > 0


def test_one_document_of_each_group_stays(steps):
    before, after = steps["near_dedup"]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert sorted(groups[k] for k in ids(after)) == sorted(set(groups.values()))


def test_contaminated_documents_go_and_no_others(spark, steps):
    before, after = steps["decontamination"]
    found = decontaminate.measure(before, load(spark, SMALL, "benchmark")).where(~F.col("contaminated"))
    assert ids(after) == ids(found)


def test_private_data_is_replaced_and_nothing_else(steps):
    before, after = steps["pii"]
    texts = {r["doc_id"]: r for r in before.select("doc_id", "text", pii.entities(F.col("text")).alias("found")).collect()}
    assert ids(before) == ids(after)
    for r in after.collect():
        old = texts[r["doc_id"]]
        assert not [value for value in old["found"] if value in (r["text"] or "")]
        assert old["found"] or r["text"] == old["text"]


def test_the_mix_takes_what_it_planned(steps):
    before, after = steps["mixing"]
    planned = mixing.plan(before.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()
    taken = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["whole"] * r["n"] + r["more"] for r in planned if r["whole"] * r["n"] + r["more"]} == taken


def test_run_gives_the_last_stages_rows(spark, steps):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == steps["mixing"][1].columns
    assert sorted(map(str, rows.select("doc_id", "copy_no").collect())) == sorted(map(str, steps["mixing"][1].select("doc_id", "copy_no").collect()))
    assert corpus_pipeline.ORACLE_SQL is None
