"""Context-tree weighting against direct evaluation of its definition."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from statledger.llm import ctw

TEXTS = ["the cat sat on the mat", "The hat and the cat", "a mat, a hat; a cat!", "", "tttt"]
PROBES = ["the cat", "zebra mat", "", "HAT hat"]


def tree(texts):
    counts = defaultdict(lambda: [0, 0])
    for text in texts:
        data = bytes(ctw.text_bytes(text.encode()))
        for at in range(ctw.DEPTH, len(data)):
            for bit in range(8):
                prefix, value = (1 << bit) | (data[at] >> (8 - bit)), (data[at] >> (7 - bit)) & 1
                for depth in range(ctw.DEPTH + 1):
                    counts[data[at - depth:at], prefix][value] += 1
    return counts


def log_kt(zeros, ones):
    return math.lgamma(zeros + .5) + math.lgamma(ones + .5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def weighted(counts, context, prefix):
    own = log_kt(*counts[context, prefix])
    if len(context) == ctw.DEPTH:
        return own, None
    product = sum(weighted(counts, c, p)[0] for c, p in list(counts)
                  if p == prefix and len(c) == len(context) + 1 and c[1:] == context)
    return math.log(0.5) + max(own, product) + math.log1p(math.exp(-abs(own - product))), own - product


def chance(counts, known, context, prefix, value):
    path = [context[len(context) - d:] for d in range(ctw.DEPTH + 1) if context[len(context) - d:] in known]
    estimate = lambda c: (counts.get((c, prefix), [0, 0])[value] + .5) / (sum(counts.get((c, prefix), [0, 0])) + 1)
    mixed = estimate(path[-1])
    for c in reversed(path[:-1]):
        odds = weighted(counts, c, prefix)[1] if (c, prefix) in counts else 0.0
        share = 1 / (1 + math.exp(odds))
        mixed = share * mixed + (1 - share) * estimate(c)
    return mixed


def test_scores_equal_the_definition(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    model = ctw.Model(ctw.node_counts(ctw.count_runs(docs)))
    scorer = ctw.Scorer(*model.state())
    counts = tree(TEXTS)
    known = {c for c, _ in counts}
    symbols = set(model.symbols.tolist())
    for probe, found in zip(PROBES, scorer.score([p.encode() for p in PROBES]), strict=True):
        data = bytes(ctw.text_bytes(probe.encode()))
        if not set(data) <= symbols:
            assert found < 0
            continue
        total = 0.0
        for at in range(ctw.DEPTH, len(data)):
            for bit in range(8):
                prefix, value = (1 << bit) | (data[at] >> (8 - bit)), (data[at] >> (7 - bit)) & 1
                total += math.log10(chance(counts, known, data[at - ctw.DEPTH:at], prefix, value))
        assert found == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_each_node_predicts_with_total_one(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    model = ctw.Model(ctw.node_counts(ctw.count_runs(docs)))
    spare = 256 - (model.width - 1)
    sums = (10.0 ** model.table[:, :-1].astype(float)).sum(axis=1) + spare * 10.0 ** model.table[:, -1].astype(float)
    assert sums == pytest.approx(1.0, abs=1e-4)


def test_long_texts_score_the_same_in_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    scorer = ctw.Scorer(*ctw.Model(ctw.node_counts(ctw.count_runs(docs))).state())
    texts = [t.encode() for t in PROBES]
    whole = scorer.score(texts)
    monkeypatch.setattr(ctw, "_AT_ONCE", 3)
    assert scorer.score(texts) == pytest.approx(whole)


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(ctw, "FREQUENT", 2)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 4)], "doc_id long, text string")
    rows = ctw.score(docs).collect()
    training = [r["doc_id"] for r in rows if not r["held_out"]]
    assert 0 < len(training) < len(rows)
    texts = dict(enumerate(TEXTS * 4))
    counts = Counter(w for k in training for w in texts[k].lower().split())
    counts[None] = len(training)
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        tokens = texts[r["doc_id"]].lower().split() + [None]
        base = sum(math.log10((counts[t] + .5) / (total + .5 * (distinct + 1))) for t in tokens)
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), total)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(base)


def test_no_byte_is_impossible_after_millions_of_others():
    often = 2**23 + 1
    runs = {d: [(0, 97, 1000), (0, 98, often)] if d == 0 else [(97, 98, often), (98, 97, 1000)] for d in range(ctw.DEPTH + 1)}
    levels = [tuple(np.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (np.int64, np.int64, float), strict=True))
              for rows in runs.values()]
    assert np.isfinite(ctw.Model(levels).table).all()


def test_contexts_beyond_the_most_frequent_score_by_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(ctw, "MOST_CONTEXTS", 3)
    monkeypatch.setattr(ctw, "_RUNS_AT_ONCE", 7)
    texts = [*TEXTS, "zebras at the cat's mat", "hat zoo"] * 3
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = ctw.score(docs).collect()
    training = [texts[r["doc_id"]] for r in rows if not r["held_out"]]
    counts = tree(training)
    known = {c for c, _ in counts}
    symbols = {b for t in training for b in bytes(ctw.text_bytes(t.encode()))}
    checked = 0
    for r in rows:
        data = bytes(ctw.text_bytes(texts[r["doc_id"]].encode()))
        if not set(data) <= symbols:
            continue
        total = 0.0
        for at in range(ctw.DEPTH, len(data)):
            for bit in range(8):
                prefix, value = (1 << bit) | (data[at] >> (8 - bit)), (data[at] >> (7 - bit)) & 1
                total += math.log10(chance(counts, known, data[at - ctw.DEPTH:at], prefix, value))
        assert r["score"] == pytest.approx(total, rel=1e-5, abs=1e-4)
        checked += r["held_out"]
    assert 0 < checked < len(rows)


def test_scores_do_not_depend_on_what_travels_with_the_model(spark, monkeypatch):
    texts = [*TEXTS, "new words żółw \x07", "zzzz", None] * 4
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in ctw.score(docs).collect()}
    monkeypatch.setattr(ctw, "MOST_CONTEXTS", 2)
    monkeypatch.setattr(ctw, "_AT_ONCE", 3)
    again = {r["doc_id"]: r["score"] for r in ctw.score(docs).collect()}
    assert again == pytest.approx(found)
