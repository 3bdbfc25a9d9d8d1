"""Packing against the tokenizer itself and against best fit over single items."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statledger.llm import packing, vocabulary

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    held = defaultdict(list)
    for row in rows:
        held[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def single_items(counts, capacity):
    """Sequences of the same method, one item after the other."""
    items = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    large, halves = [x for x in items if 2 * x > capacity], [x for x in items if 2 * x <= capacity < 3 * x]
    rooms = []
    for x in large:
        partner = next((h for h in halves if h <= capacity - x), None)
        if partner:
            halves.remove(partner)
        rooms.append(capacity - x - (partner or 0))
    while halves:
        rooms.append(capacity - sum(halves[:2]))
        halves = halves[2:]
    for x in (x for x in items if 3 * x <= capacity):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(capacity - x)
        else:
            rooms[rooms.index(fit)] = fit - x
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_the_method_over_single_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    spread = rng.choice([capacity, capacity // 2, capacity // 3 + 1])
    counts = dict(Counter(rng.randint(1, spread) for _ in range(rng.randint(1, 300))))
    fill, numbers = Counter(), defaultdict(list)
    for length, first, count, each, sequence, offset in packing.plan(counts, capacity):
        numbers[length] += range(first, first + count)
        assert count % each == 0
        for k in range(count):
            assert fill[sequence + k // each] == offset + k % each * length
            fill[sequence + k // each] += length
    assert all(sorted(numbers[x]) == list(range(n)) for x, n in counts.items())
    assert sorted(capacity - f for f in fill.values()) == single_items(counts, capacity)


def test_plan_is_small_for_large_tables():
    steps = packing.plan({x: 10**9 + 7919 * x for x in range(1, 2049)})
    assert len(steps) < 20_000
    total = sum(x * (10**9 + 7919 * x) for x in range(1, 2049))
    last = max(s[4] + s[2] // s[3] for s in steps)
    assert total / 2048 <= last < 1.01 * total / 2048
    with pytest.raises(ValueError):
        packing.plan({0: 1})


TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "Some Words, here's <|endoftext|> 12345 été ́x Straße 　İI",
    "word " * 5000, "x" * 9000, "\U0001f600‍ мир ΣΑΣ don't a\x1fb\x85c", "same text", "same text",
]


def test_pieces_are_those_of_the_tokenizer(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs = docs.selectExpr("*", "'x' as piece", "1 as length", "2 as lot", "3 as ids")
    rows = packing.pack(docs, VOCABULARY, keep_ids=True).collect()
    made = Tokenizer.from_file(VOCABULARY)
    for doc_id, text in enumerate(TEXTS):
        ids = made.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048)
        for r in own:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert bytes(r["ids"]) == part and r["ids_crc32"] == crc32(part) and r["start"] == 2048 * r["piece"]
    check(rows, 2048)
    packed = packing.pack(docs, VOCABULARY, keep_ids=True)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert sum(len(r["ids"]) for r in whole.values()) == 4 * sum(r["length"] for r in rows)
    for r in whole.values():
        assert 4 * sum(d["length"] for d in r["documents"]) == len(r["ids"]) <= 4 * 2048


def test_a_third_of_the_rows_of_one_length(spark):
    docs = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'the same row', repeat('word ', cast(id % 900 as int))) as text")
    rows = packing.pack(docs.repartition(7), VOCABULARY).collect()
    assert len(rows) == 3000
    used = check(rows, 2048)
    assert used <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, VOCABULARY).collect()
    made = Tokenizer.from_file(VOCABULARY)
    total = sum(len(made.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == total
    assert check(rows, 2048) <= 1.02 * total / 2048 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z.'1sLVEöÀØĿİ<|>_\n\tÉéß́ 　\x01\x1c日ΣK"), max_size=30), max_size=4))
def test_ids_of_any_text(encoder, texts):
    made, encode = encoder
    words = [packing._words(text.encode()) for text in [*texts, "<|endoftext|> <|EndOfText|>a it's"]]
    table = vocabulary.WordIds(lambda new: encode([w.decode() for w in new]))
    table.learn(words)
    for text, own in zip(texts, words, strict=False):
        assert table.of(own) == vocabulary.packed(made.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def encoder():
    return Tokenizer.from_file(VOCABULARY), vocabulary.word_end_encoder(vocabulary.tokenizer(VOCABULARY, special_as_text=False))
