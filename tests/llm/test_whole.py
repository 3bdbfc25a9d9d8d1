"""Whole jobs: no text takes another's place, no part of a text is passed by."""

import numpy as np

from statledger.llm import toxicity


def test_a_long_text_takes_no_other_texts_place_in_training(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 2000, raising=False)
    ids = spark.range(300).selectExpr("id", "xxhash64(id) as draw", "crc32(cast(id as string)) % 3 as fold").orderBy("draw").collect()
    first = next(r["id"] for r in ids if r["fold"] != toxicity.HELD_OUT)
    texts = [f"plain words {k} stand here {'vile' if k % 2 else 'kind'} and end" for k in range(300)]
    texts[first] = "filler words " * 2000 + texts[first]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).where(f"doc_id <> {first}").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in rows]) > 0.95


def test_every_window_of_a_text_is_scored():
    rng = np.random.default_rng(0)
    words = [str(k).encode() for k in range(40)]
    net = toxicity.Net({w: k for k, w in enumerate(words)}, rng.normal(0, 2, 42), np.zeros(toxicity._GRAMS))
    for count in (5, toxicity.WINDOW, toxicity.WINDOW + 1, 33, 150):
        text = [words[k] for k in rng.integers(0, 40, count)]
        each = [b" ".join(text[k:k + toxicity.WINDOW]) for k in range(max(1, count - toxicity.WINDOW + 1))]
        tops = toxicity.top_logits(net, [*each, b" ".join(text), b"", b" ".join(text)], toxicity._Words(net))
        assert tops[-3] == tops[-1] and tops[-3] == np.float32(max(tops[:len(each)])) and tops[-2] == -np.inf


def test_training_windows_are_drawn_over_the_whole_text():
    words = [str(k).encode() for k in range(10_000)]
    drawn = toxicity.drawn_windows(words, -5)
    assert len(drawn) == toxicity.TRAIN_PER_DOC and all(len(w) == toxicity.WINDOW for w in drawn)
    places = 10_001 - toxicity.WINDOW
    assert all(k * places // 16 <= int(w[0]) <= (k + 1) * places // 16 for k, w in enumerate(drawn))
    assert toxicity.drawn_windows(words[:5], 1) == [words[:5]] and toxicity.drawn_windows([], 1) == []


def test_a_text_scores_alike_in_any_batch():
    rng = np.random.default_rng(1)
    words = [str(k).encode() for k in range(900)]
    net = toxicity.Net({w: k for k, w in enumerate(words[:40])}, rng.normal(0, 2, 42), rng.normal(0, 1, toxicity._GRAMS))
    texts = [b" ".join(words[k] for k in rng.integers(0, 900, count)) for count in rng.integers(0, 400, 200)]
    tops = toxicity.top_logits(net, texts, toxicity._Words(net))
    order = rng.permutation(len(texts))
    assert (toxicity.top_logits(net, [texts[k] for k in order], toxicity._Words(net)) == tops[order]).all()
    alone = toxicity._Words(net)
    assert all(toxicity.top_logits(net, [text], alone)[0] == top for text, top in zip(texts, tops, strict=True))


def test_scoring_is_the_net_that_was_trained():
    rng = np.random.default_rng(2)
    words = [str(k).encode() for k in range(40)]
    net = toxicity.Net({w: k for k, w in enumerate(words)}, rng.normal(0, 2, 42), rng.normal(0, 1, toxicity._GRAMS))
    table = toxicity._Words(net)
    for count in (1, 3, toxicity.WINDOW - 1, toxicity.WINDOW, 200):
        text = [words[k] for k in rng.integers(0, 40, count)]
        each = [text[k:k + toxicity.WINDOW] for k in range(max(1, count - toxicity.WINDOW + 1))]
        rows = np.zeros((len(each), toxicity.WINDOW), np.int32)
        for row, window in zip(rows, each, strict=True):
            row[:len(window)] = table.rows(window)
        top = toxicity.top_logits(net, [b" ".join(text)], table)[0]
        assert abs(net.forward(table.table[rows], rows > 0).max() - top) < 1e-5
