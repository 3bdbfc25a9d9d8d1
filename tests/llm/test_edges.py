"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from statledger.llm import (
    ctw,
    decontaminate,
    host_rules,
    language,
    licenses,
    mixing,
    pii,
    quality_model,
    simhash,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id long, text string"
LONG = "one two three four five " * 40_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, "   \n\t ", None, "a", None),
    (None, "text without an id", "en", "a", 1), (4, "the same row twice here", "en", "b", 5),
    (4, "the same row twice here", "en", "b", 5), (5, LONG, "en", "b", 9), (6, "123 456", None, None, 0),
    (7, "Größe und Maß der Dinge \U0001f600 мир", "de", "c", 3),
] + [(10 + k, f"some words of document {k} stand here, idiot{k % 3}", "en" if k % 2 else "de", "d", k) for k in range(40)]
MARKS = [(k, k % 2, (k // 2) % 2) for k in range(50)] + [(None, 1, 1), (7, None, None)]
ITEMS = [(1, None), (2, ""), (3, "the same row twice here"), (None, "Maß der Dinge"), (4, "one two three four five " * 5)]

OPERATORS = {
    "toxicity": lambda d, m, b: toxicity.score(d, m),
    "decontaminate": lambda d, m, b: decontaminate.measure(d, b),
    "language": lambda d, m, b: language.predict(d),
    "quality": lambda d, m, b: quality_model.score(d, m),
    "simhash": lambda d, m, b: simhash.near_duplicates(d),
    "pii": lambda d, m, b: pii.surrogates(d),
    "mixing": lambda d, m, b: mixing.mix(d),
    "host_rules": lambda d, m, b: host_rules.judge(d),
    "licenses": lambda d, m, b: licenses.find(d),
    "ctw": lambda d, m, b: ctw.score(d),
}
STAGES = {
    "toxicity": lambda d, m, b: toxicity.remove(d, m),
    "near_dedup": lambda d, m, b: simhash.keep_first(d),
    "decontamination": lambda d, m, b: decontaminate.remove(d, b),
    "pii": lambda d, m, b: pii.replace(d)[0],
    "mixing": lambda d, m, b: mixing.mixed(d),
}
CLASHING = ("fp hits found toxicity n_entities key copy_no mix_size kept_id words stats row rank count pii_key what"
            " cut score node text_ size").split()


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(MARKS, LABELS), spark.createDataFrame(ITEMS, BENCHMARK)


@pytest.fixture(scope="module")
def nothing(spark):
    return tuple(spark.createDataFrame([], schema) for schema in (DOCS, LABELS, BENCHMARK))


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(tables, name):
    rows = OPERATORS[name](*tables).collect()
    assert len(rows) == len(ROWS)
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)
    twice = [r for r in rows if r["doc_id"] == 4]
    assert twice[0] == twice[1] or name == "mixing"  # there they share their copies


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(nothing, name):
    assert OPERATORS[name](*nothing).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_without_other_tables(tables, nothing, name):
    assert OPERATORS[name](tables[0], nothing[1], nothing[2]).count() == len(ROWS)


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_with_clashing_names(tables, nothing, name):
    docs = tables[0]
    for column in CLASHING:
        docs = docs.selectExpr("*", f"doc_id as `{column}`")
    kept = STAGES[name](docs, *tables[1:])
    assert kept.columns[:len(docs.columns)] == docs.columns
    rows = kept.collect()
    assert rows and all(r["fp"] == r["doc_id"] == r["score"] for r in rows)
    assert STAGES[name](*nothing).collect() == []
