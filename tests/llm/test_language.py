"""Language identification: bounds that decide nothing, and the smallest size by brute force."""

import random

import pytest
import zstandard

from statledger.llm import language


def words_of(seed, count=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(count)]


def text_of(seed, length, draw):
    rng = random.Random(f"{seed}/{draw}")
    words = words_of(seed)
    return " ".join(rng.choice(words) for _ in range(length))


def table(spark, languages, per_language=8, length=120):
    rows = [(k * per_language + d, text_of(k, length, d), f"l{k:03d}") for k in range(languages) for d in range(per_language)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_texts_without_a_letter(spark):
    docs = table(spark, 3).union(spark.createDataFrame(
        [(900, "½ ² 12", "l001"), (901, "一", None), (902, "Ⅷ ٣", None), (903, None, "l001"), (904, "ª", None)], "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs).collect()}
    assert [found[k] for k in (900, 902, 903)] == ["und"] * 3 and "und" not in (found[901], found[904])


def test_every_language_can_be_found_in_any_number_of_passes(spark):
    docs = table(spark, 250, 6).cache()
    passes = list(language.learn(docs, per_pass=200))
    assert [len(p) for p in passes] == [200, 50]
    some = docs.where("doc_id % 25 = 1")
    in_two = {tuple(r) for r in language.identify(some, passes).collect()}
    in_one = {tuple(r) for r in language.identify(some, [passes[0] | passes[1]]).collect()}
    assert in_two == in_one
    assert sum(r[2] == r[3] for r in in_two) >= 0.98 * len(in_two)


def test_a_row_repeated_very_often_takes_no_room(spark):
    docs = table(spark, 2, 1000, 40)
    often = spark.range(300_000).selectExpr("5 as doc_id", "'the same row here' as text", "'l000' as lang")
    contents, = language.learn(docs.union(often))
    alone, = language.learn(docs)
    for name in contents:
        kept = [len(part.split(b"\n")) for part in contents[name]]
        assert sum(kept) >= 390 and abs(sum(kept) - sum(len(p.split(b"\n")) for p in alone[name])) <= 12


def test_a_shared_beginning_does_not_fill_the_dictionaries(spark):
    header = "copyright notice of this site " * 60
    docs = table(spark, 2, 500, 300).selectExpr("doc_id", f"concat('{header}', text) as text", "lang")
    contents, = language.learn(docs)
    for parts in contents.values():
        own = b"\n".join(parts)
        assert len(own) <= 3 * language.DICTIONARY_BYTES + 3 * 400
        assert 6 * own.count(b"notice") < 0.75 * len(own.split())


@pytest.mark.parametrize("sizes,share", [([], 0), ([10] * 5, 14_000), ([200_000] * 2, 72_000), ([100, 200_000, 200_000], 71_950)])
def test_share_fills_the_dictionaries(sizes, share):
    got = language._share(sizes)
    assert sum(min(s, got) for s in sizes) <= 144_000
    if share and max(sizes) > share:
        assert got == share


def test_the_smallest_size_wins():
    contents = {f"l{k}": [text_of(k, 400, d).encode() for d in range(3)] for k in range(4)}
    languages = language._Languages(contents)
    for k in range(12):
        data = (text_of(k % 5, 30 + 40 * k, "x")).encode()
        sizes = {}
        search = zstandard.ZstdCompressionParameters(**language._SEARCH)
        for name, own in contents.items():
            held = zstandard.ZstdCompressionDict(own[0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(compression_params=search, dict_data=held)
            sizes[name] = sum(len(packer.compress(data[at:at + 2048])) for at in range(0, len(data), 2048))
        first, second = sorted((size, name) for name, size in sizes.items())[:2]
        found, score, rejected = language.judge(languages.steps(data))
        margin = (second[0] - first[0]) / second[0]
        if margin >= language.NARROW:
            assert (found, rejected) == (first[1], False) and score == min(1.0, 0.5 + 5 * margin)
    tie = language.judge([[(100, "a"), (100, "b")]])
    assert tie == ("a", 0.5, True)
