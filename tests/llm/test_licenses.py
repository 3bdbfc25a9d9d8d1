"""License scans with templates of the caller's own."""

import pytest

from statledger.llm import licenses

LONG = " ".join(f"clause{k} of the terms" for k in range(200))


@pytest.fixture(scope="module")
def found(spark):
    table = spark.createDataFrame([
        ("long", LONG, ["clause7 of the terms"]), ("short", "all rights kept by nobody", ["rights kept"]),
        ("strict", "words that many files have", ["words that", "never there"]),
    ], "label string, notice string, phrases array<string>")
    texts = [
        None, "", f"// {LONG.upper()} //", f"{LONG}\n\n* All Rights\tkept, by nobody!",
        LONG.replace("clause7 of", "clause7 without"), "nobody kept all rights by the terms", "words that many files have",
        "rights kept " + "filler " * 50 + "by nobody", "under the MIT license and Apache License, version 2.0; CC-BY-NC",
        "under the mıt license Kept by Nobody rights, all", "all rights Kept by nobody", "plain words " * 2000 + " all rights kept by nobody",
    ] + [f"words that many files have {k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return {r["doc_id"]: r for r in licenses.find(docs, table).collect()}


def test_templates_of_any_length(found):
    labels = {k: found[k]["labels"] for k in range(12)}
    assert labels == {0: "", 1: "", 2: "long", 3: "long,short", 4: "", 5: "", 6: "", 7: "", 8: "apache-2,cc-by-nc,mit", 9: "", 10: "", 11: "short"}
    assert found[2]["score"] == found[11]["score"] == 1.0 and found[7]["score"] == 0.0


def test_base_phrases(found):
    row = found[8]
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (13, 3, 0, 10)
    assert row["base_labels"] == "apache-2,cc-by-nc,mit" and found[9]["n_base"] == 0 and found[9]["first_word"] is None


def test_no_templates(spark):
    docs = spark.createDataFrame([(1, "cc by nc cc by nc")], "doc_id long, text string")
    none = spark.createDataFrame([], "label string, notice string, phrases array<string>")
    row, = licenses.find(docs, none).collect()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (2, 0, 3, "cc-by-nc")
