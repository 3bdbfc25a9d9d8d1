"""Alignment against both tokenizers read on whole texts and a plain walk over their ends."""

from collections import Counter, defaultdict
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statledger.llm import alignment, vocabulary

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = vocabulary.byte_alphabet()

    def tokens(text):
        text = text or ""
        if not text:
            return [], []
        own = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                 for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        spelled = (" " + text).encode()
        return (own, other) if all(b"".join(t for _, t in side) == spelled for side in (own, other)) else ([], [])

    return tokens


def walk(a, b):
    """Groups of ids by walking both lists a token at a time."""
    groups, left, right, i, j, x, y = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            left.append(a[i][0])
            x += len(a[i][1])
            i += 1
        else:
            right.append(b[j][0])
            y += len(b[j][1])
            j += 1
        if x == y and left and right:
            groups.append((left, right))
            left, right = [], []
    return groups


def expected(plain, texts):
    groups = [walk(*plain(t)) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows = []
    for own in groups:
        linked = [(g[0][-1], g[1][-1]) for g in own]
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in own)
        rows.append((
            sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(own),
            sum(counts[p] == highest[p[1]] for p in linked), sum(counts[p] for p in linked),
            sha256(line.encode()).hexdigest() if own else ""))
    return rows


TEXTS = [
    None, "", " ", "  two  spaces ", "\n a\t b\r\n  c", "<|endoftext|> <s> <unk> <0x41> </s>", "a▁b ▁ c", "zero\x00byte a\x1c b",
    "Straße мир 日本語　テキスト\U0001f600‍ é ́x", "don't it's   I'll", "   \n\n   x", "same row", "same row", "a " * 5000,
    "x" * 3000, "ab" * 2000 + " " * 1000 + "c", "\u0085next line em  sep ᠎ mv",
]


def result(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as links", "2 as n_a", "'x' as groups_sha256")
    return [tuple(r)[1:] for r in sorted(alignment.align(docs, A, B).collect(), key=lambda r: r["doc_id"])]


def test_edges(spark, plain):
    assert result(spark, TEXTS) == expected(plain, TEXTS)


def test_whole_documents(spark, sf_dir, plain):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert result(spark, texts) == expected(plain, texts)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z.'1öÀİ\n\t  ▁é日 \x1c")), max_size=5))
def test_any_text(aligner, plain, texts):
    spelled = aligner.spelled_groups(aligner([t.encode() for t in texts]))
    for text, own in zip(texts, spelled, strict=True):
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in walk(*plain(text)))
        assert own.decode() == line


def test_overlaps_share_bytes(spark, plain):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in alignment.aligned(docs, A, B).collect():
        sides = plain(TEXTS[row["doc_id"]])
        assert [row["a_ids"], row["b_ids"]] == [[i for i, _ in s] for s in sides]
        short, long = sides if row["shorter"] == "a" else sides[::-1]
        short, long = ([(end - len(t), end) for (_, t), end in zip(s, accumulate(len(t) for _, t in s), strict=True)] for s in (short, long))
        assert len(row["overlaps"]) == len(short)
        for (start, end), found in list(zip(short, row["overlaps"], strict=True))[:200]:
            shared = [k for k, (x, y) in enumerate(long) if x < end and y > start]
            assert (found["first"], found["last"]) == (shared[0], shared[-1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 900), min_size=1), st.sets(st.integers(0, 900))), min_size=1, max_size=4))
def test_ranks_are_those_of_a_search(lists):
    shorter = np.concatenate([np.sort(list(a)) + 1000 * k for k, (a, b) in enumerate(lists)])
    longer = np.concatenate([np.sort(np.array(list(b), int)) + 1000 * k for k, (a, b) in enumerate(lists)])
    starts = np.cumsum([0] + [len(a) for a, _ in lists])[:-1]
    origins = np.cumsum([0] + [len(b) for _, b in lists])[:-1]
    assert (alignment.ranks(shorter, starts, longer, origins) == np.searchsorted(longer, shorter)).all()


def test_pairs_that_can_end_together_are_few():
    assert alignment.most_pairs(A, B) < 1_000_000
