"""Operators against brute force, and models by their accuracy on documents they never saw."""

import itertools
import os
import random
import sys
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from statledger.llm import decontaminate, language, mixing, pii, quality_model, simhash, toxicity
from statledger.llm.tables import held_out, load

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [words[k:k + 3] for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= simhash.RADIUS:
            parent[find(a)] = find(b)
    groups = defaultdict(set)
    for v in values:
        groups[find(v)].add(v)
    return {frozenset(g) for g in groups.values()}


def near_values(count, seed=1):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(count // 20)]
    values = set()
    while len(values) < count:
        v = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        values.add(v - (1 << 64) if v >> 63 else v)
    return sorted(values)


@pytest.mark.parametrize("tree_size", [4, 512])
def test_links_connect_what_brute_force_connects(spark, tree_size):
    values = near_values(300)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, tree_size=tree_size)).collect()}
    found = defaultdict(set)
    for v in values:
        found[roots.get(v, v)].add(v)
    assert {frozenset(g) for g in found.values()} == brute_components(values)


def test_near_duplicates_equal_brute_force(spark):
    rows = load(spark, SMALL, "documents").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    component = {}
    for group in brute_components(sorted(set(prints.values()))):
        own = [d for d, v in prints.items() if v in group]
        component |= dict.fromkeys(own, min(own))
    found = simhash.near_duplicates(load(spark, SMALL, "documents")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {
        d: (f"{v:016x}", component[d]) for d, v in prints.items()}
    kept = simhash.keep_first(load(spark, SMALL, "documents"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(component.values()))


def test_passes_over_parts_of_the_benchmark_find_the_same(spark):
    docs, bench = load(spark, SMALL, "documents"), load(spark, SMALL, "benchmark")
    found = []
    for size in (10**6, 200):
        scanned, hits = decontaminate.scan(docs, bench, windows_per_pass=size)
        found.append({r["doc_id"]: (r[hits]["n_hit"], bytes(r[hits]["marks"]), sorted(r[hits]["items"]))
                      for r in scanned.select("doc_id", hits).collect()})
    assert found[0] == found[1] and any(n for n, _, _ in found[0].values())


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "keep this, " + " ".join(f"w{k}" for k in range(13)) + ". And " + "more " * 400)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"W{k}" for k in range(13)))], "item_id long, text string")
    text = decontaminate.remove(docs, bench, spans=True).first()["text"]
    assert text.startswith("keep this, . And more") and "w5" not in text


def brute_targets(sizes):
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    goal, full, open_now = mixing.SHARE * sum(sizes.values()), {}, dict(sizes)
    while True:
        share = (goal - sum(full.values())) / sum(weights[s] for s in open_now)
        over = [s for s in open_now if weights[s] * share > 2 * open_now[s]]
        if not over:
            return full | {s: weights[s] * share for s in open_now}
        full |= {s: 2 * open_now.pop(s) for s in over}


def test_mix_meets_its_targets_and_reruns_agree(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert target == pytest.approx(brute_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in target)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_surrogates_keep_distinctness_coreference_and_format(spark):
    rng = random.Random(3)
    mails = [f"user.{k}@mail{k % 3}.example.com" for k in range(60)]
    phones = [f"+1 ({rng.randrange(200, 999)}) 555-{k:04d}" for k in range(60)]
    docs = [(k, f"Mail {mails[k]} or {mails[k].upper()}, call {phones[k]}. Mrs Anna Berg knows {mails[(k + 1) % 60]}") for k in range(60)]
    rows = pii.surrogates(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    words = [r["text"].replace(",", " ").split() for r in rows]
    first = [w[1] for w in words]
    assert len(set(first)) == 60 and not set(first) & set(mails)
    assert all(w[3].lower() == w[1] and w[3].isupper() for w in words)
    assert all(r["text"].endswith(first[(k + 1) % 60]) for k, r in enumerate(rows))
    assert all(r["n_entities"] == 5 and "Mrs " in r["text"] and "Anna" not in r["text"] for r in rows)
    assert len({r["text"].split("call ")[1][:17] for r in rows}) == 60


def accuracy(scored, labels, label, folds, remainder):
    known = scored.join(labels, "doc_id").where(held_out("doc_id", folds, remainder))
    return known.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


@pytest.fixture(scope="module")
def tenth(spark):
    return load(spark, "/root/testdata/sf0.1", "documents"), load(spark, "/root/testdata/sf0.1", "labels")


def test_toxicity_accuracy(tenth):
    assert accuracy(toxicity.score(*tenth), tenth[1], "toxic", 3, 1) > 0.95


def test_quality_accuracy(tenth):
    assert accuracy(quality_model.score(*tenth), tenth[1], "quality", 4, 2) > 0.98


def test_language_accuracy(tenth):
    found = language.predict(tenth[0]).withColumnRenamed("lang_pred", "predicted")
    assert accuracy(found, tenth[0].select("doc_id", "lang"), "lang", 5, 0) > 0.97


def test_isotonic_steps_rise():
    _, values = quality_model.isotonic([0, 1, 2, 3], [0, 3, 1, 4], [4, 4, 4, 4], 0.5)
    assert values == pytest.approx([0.1, 0.1, 0.5, 0.5, 0.9, 0.9])


def test_gradients_equal_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    net = toxicity.Net({b"a": 0}, np.zeros(3), np.zeros(toxicity._GRAMS), seed=1)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    gates, mask = rng.normal(size=(3, 5, 48)), np.ones((3, 5), bool)
    mask[0, 3:] = False
    y = np.array([0.0, 1.0, 1.0])

    def loss(g):
        p = toxicity._sigmoid(net.forward(g, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found, _ = net.gradients(gates, mask, y, np.ones(3))
    for place in [(0, 1, 3), (1, 4, 30), (2, 0, 20)]:
        step = np.zeros_like(gates)
        step[place] = 1e-2
        assert found[place] == pytest.approx((loss(gates + step) - loss(gates - step)) / 2e-2, rel=0.05, abs=2e-4)


def test_oracles_agree(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import compare

    from statledger.llm.queries import ORACLES, QUERIES

    duck = compare.connect(SMALL)
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    for name, sql in ORACLES.items():
        assert compare.differences(QUERIES[name](spark, SMALL), duck, sql) is None
