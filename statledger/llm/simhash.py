"""SimHash near-duplicates by BK-trees over shards of the fingerprints.

Two 64-bit fingerprints with at most RADIUS = 3 differing bits agree on at least two of
five bit ranges. Each of the ten pairs of ranges, with the bits that stand there, names a
shard, so every linked pair meets in one. A shard's fingerprints form a BK-tree: a child
hangs at its Hamming distance from its parent, and a search follows only the edges whose
distance is within the radius of the probe's own. Fingerprints are distinct before they
are sharded, so copies cost nothing here.

A shard is sent to the task that searches it, not to every executor: all trees together
grow with the corpus. A shard of more than TREE_SIZE fingerprints is cut into parts of
about that many; each pair of parts is a tree of its own, so the memory of a task stays
bounded and no link is lost. Links are kept as edges to the smallest fingerprint of each
tree's component, never as all pairs, and joined by large-star/small-star rounds.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from statledger.llm.tables import append_columns, free_name
from statledger.session import written

RADIUS = 3
TREE_SIZE = 512
SHINGLE = 3
_SEED = 42
_RANGES = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_AT_ONCE = 1 << 16


def fingerprint(data: bytes) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 for a text without words.

    Words are runs of what is no ASCII space, A-Z lowered; a bit is set if over half of
    the shingles' XXH64 values have it. Texts are hashed whole, in bounded steps.
    """
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        total = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _AT_ONCE):
        count = min(_AT_ONCE, total - start)
        hashes = np.fromiter((digest(s, _SEED) for s in itertools.islice(shingles, count)), np.uint64, count)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> tuple:
    """docs with the fingerprint as a long, and that column's name."""
    field = StructField(free_name(docs, "fp"), LongType())
    return append_columns(docs, [text], [field], lambda: lambda texts: [list(map(fingerprint, texts))]), field.name


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def tree_links(values: list) -> list:
    """(value, smallest value of its component) for the distinct signed fingerprints that
    have a partner within the radius, found by one BK-tree.

    A subtree whose nodes all belong to one component is left out when the probe belongs
    to it too, so a dense group doesn't cost a visit for each of its pairs.
    """
    mask = (1 << 64) - 1
    keys = [v & mask for v in values]
    parent = list(range(len(keys)))
    children = [{} for _ in keys]
    whole = [True] * len(keys)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(1, len(keys)):
        key, stack = keys[x], [0]
        while stack:
            node = stack.pop()
            if whole[node] and find(node) == find(x):
                continue
            d = (keys[node] ^ key).bit_count()
            if d <= RADIUS:
                a, b = find(node), find(x)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            stack.extend(child for edge, child in children[node].items() if d - RADIUS <= edge <= d + RADIUS)
        node, root = 0, find(x)
        while True:
            if find(node) != root:
                whole[node] = False
            d = (keys[node] ^ key).bit_count()
            if d not in children[node]:
                children[node][d] = x
                break
            node = children[node][d]
    groups = {}
    for x in range(len(keys)):
        groups.setdefault(find(x), []).append(values[x])
    return [(v, min(g)) for g in groups.values() if len(g) > 1 for v in g if v != min(g)]


def links(fps: DataFrame, fp: str = "fp", tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges (a, b) that connect what distinct fingerprints within the radius connect; b < a."""
    shards = []
    for pair, ((i, m), (j, n)) in enumerate(itertools.combinations(_RANGES, 2)):
        low = F.shiftrightunsigned(F.col(fp), i).bitwiseAND((1 << m) - 1)
        high = F.shiftrightunsigned(F.col(fp), j).bitwiseAND((1 << n) - 1)
        shards.append(F.lit(pair << 26).bitwiseOR(F.shiftleft(high, 13)).bitwiseOR(low))
    members = fps.select(F.col(fp).alias("fp"), F.explode(F.array(*shards)).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / tree_size)
    placed = members.join(sizes, "shard").select(
        "fp", "shard", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).alias("part")
    )
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    trees = placed.select("fp", "shard", "part", others).select(
        "shard",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        "fp",
    )
    keys = ["shard", "low", "high"]
    trees = trees.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return trees.mapInArrow(_search, "a long, b long").distinct()


def _search(batches):
    """Edges of each run of rows with one (shard, low, high); a run may go over batches."""
    rest = [np.empty(0, np.int64)] * 4
    for batch in itertools.chain(batches, [None]):
        new = [np.empty(0, np.int64)] * 4 if batch is None else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        shard, low, high, fp = (np.concatenate(x) for x in zip(rest, new, strict=True))
        if not len(fp):
            continue
        cut = (np.diff(shard) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        ends = np.flatnonzero(cut) + 1
        last = len(fp) if batch is None else (ends[-1] if len(ends) else 0)
        bounds = [0, *ends.tolist(), len(fp)]
        edges = []
        for start, end in itertools.pairwise(bounds):
            if end <= last and end - start > 1:
                edges += tree_links(fp[start:end].tolist())
        rest = [x[last:] for x in (shard, low, high, fp)]
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is connected to.

    Alternates large stars (each node's larger neighbours hang on its smallest one) and
    small stars (its smaller neighbours do) until nothing changes. Each round is a partial
    aggregate and a join, written out at its end.
    """
    edges = written(edges.where("a > b"), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b"))
        )).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a > b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _state(edges: DataFrame):
    sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a")))
    return tuple(sums.first())


def classes(hashed: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(fp, root, first_id): for each distinct fingerprint its class and the smallest doc_id there.

    Null ids count only where a class has no other; a repeated id is one document.
    """
    own = written(hashed.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("own_id")), "fingerprints")
    roots = components(links(own))
    known = own.join(roots, own["fp"] == roots["node"], "left").select(
        "fp", "own_id", F.coalesce("root", "fp").alias("root")
    )
    first = known.groupBy("root").agg(F.min("own_id").alias("first_id"))
    return known.join(first, "root").select("fp", "root", "first_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    Null and empty texts have fingerprint zero and are linked like any other; repeated
    rows are in one class; of equal smallest ids the id is the class's all the same. An
    empty table has no rows.
    """
    hashed, fp = fingerprints(docs.select("doc_id", "text"))
    hashed = written(hashed.select("doc_id", F.col(fp).alias("fp")), "simhash")
    return hashed.join(classes(hashed), "fp").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), F.col("first_id").alias("component_id")
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: one with the smallest doc_id, all columns as they are.

    Of repeated rows with that id one stays; a class of null ids only keeps one row too.
    """
    hashed, fp = fingerprints(docs, text)
    hashed = written(hashed, "simhash")
    small = hashed.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"))
    firsts = small.join(classes(small), "fp").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    kept_id, kept_fp = free_name(hashed, "kept_id"), free_name(hashed, "kept_fp")
    # One fingerprint for each class, since rows of one id may hold different texts.
    firsts = firsts.groupBy("root").agg(F.min("first_id").alias(kept_id), F.min("fp").alias(kept_fp))
    same = F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.col(fp) == F.col(kept_fp))
    kept = hashed.join(firsts.select(kept_id, kept_fp), same, "left_semi")
    return kept.dropDuplicates([doc_id, fp]).drop(fp)
