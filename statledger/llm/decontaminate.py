"""Benchmark decontamination.

The n-grams of the benchmark's texts, normalised, form a hash set that every task
holds; document token windows that are in the set, compared in full by their bytes,
are hits, and documents or spans with hits are removed.

A benchmark of more than WINDOWS_PER_PASS n-grams is scanned in several passes, one job
after the other, each with a part of the set. A pass writes the hits of the texts that
have any, and the passes' hits are joined with the documents at the end. So what a task
holds has a fixed bound, whatever the benchmark's size, and no n-gram is left out.
"""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from statledger.llm.tables import ALNUM_WORD, append_columns, free_name, lower_ascii
from statledger.session import written

NGRAM = 13
WINDOWS_PER_PASS = 200_000

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HITS = StructType([
    StructField("n_words", LongType()), StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())), StructField("marks", BinaryType()),
])


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Distinct (window, item): n consecutive words of an item joined by spaces; all its
    words if it has fewer, none if it has none. An item without an id has the item null."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(ALNUM_WORD), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    return (
        items.where(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("start"))
        .select(F.array_join(F.slice("words", F.col("start"), n), " ").alias("window"), "item")
        .distinct()
    )


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = NGRAM,
         windows_per_pass: int = WINDOWS_PER_PASS) -> tuple:
    """docs with a struct of n_words, n_hit, items and marks, and that column's name.

    items are the ids of the items with a window in the text, without order; marks has a
    byte for each word, 1 where a window covers it, and is empty for a text without hits.
    Null and empty texts have no words; repeated rows get the same hits; empty tables give none.
    """
    windows = written(benchmark_windows(benchmark, n), "windows")
    passes = max(1, -(-windows.count() // windows_per_pass))
    hits = StructField(free_name(docs, "hits"), _HITS)
    if passes == 1:
        return append_columns(docs, [text], [hits], _finder_of(windows)), hits.name
    texts = docs.select(F.sha2(text, 256).alias("key"), F.col(text).alias("text"))
    found = None
    for k in range(passes):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k)
        own = append_columns(texts, ["text"], [StructField("hits", _HITS)], _finder_of(part))
        own = written(own.where("hits.n_hit > 0").select("key", "hits.*").dropDuplicates(["key"]), "hits")
        found = own if found is None else found.unionByName(own)
    # As many rows a text as passes at most.
    merged = found.groupBy("key").applyInPandas(_merged, found.schema)
    key, of, words = (free_name(docs, name) for name in ("text_key", "text_key_of", "text_words"))
    merged = merged.select(F.col("key").alias(of), F.struct("n_words", "n_hit", "items", "marks").alias(hits.name))
    counted = append_columns(docs, [text], [StructField(words, LongType())], lambda: lambda t: [[len(WORD.findall(x.lower())) for x in t]])
    joined = counted.withColumn(key, F.sha2(text, 256)).join(merged, F.col(key) == F.col(of), "left")
    none = F.struct(F.col(words).alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                    F.array().cast("array<string>").alias("items"), F.lit(b"").alias("marks"))
    return joined.withColumn(hits.name, F.coalesce(hits.name, none.cast(_HITS))).drop(key, of, words), hits.name


def _finder_of(windows: DataFrame):
    """Maker of the finder of these windows, which are broadcast."""
    index = defaultdict(list)
    for window, item in windows.collect():
        index[window.encode()] += [] if item is None else [item]
    shared = windows.sparkSession.sparkContext.broadcast(dict(index))
    return lambda: _finder(shared.value)


def _merged(rows):
    """One text's hits of several passes as one row."""
    marks = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in rows["marks"]])
    items = sorted({item for own in rows["items"] for item in own})
    return pd.DataFrame({"key": rows["key"][:1], "n_words": rows["n_words"][:1], "n_hit": [int(marks.sum())],
                         "items": [items], "marks": [marks.tobytes()]})


def _finder(index: dict):
    """Finder of the index's windows in texts.

    A window can only stand in a run of words that all occur in the index, so runs are
    found first and only their windows are joined and looked up.
    """
    by_length = defaultdict(dict)
    for window, ids in index.items():
        by_length[window.count(b" ") + 1][window] = ids
    known = {word for window in index for word in window.split(b" ")}

    def compute(texts):
        found = []
        for data in texts:
            words = WORD.findall(data.lower())
            marks, items = None, set()
            in_run = bytes(map(known.__contains__, words))
            for length, windows in by_length.items():
                run = b"\x01" * length
                at = in_run.find(run)
                while at >= 0:
                    ids = windows.get(b" ".join(words[at:at + length]))
                    if ids is not None:
                        marks = marks or bytearray(len(words))
                        marks[at:at + length] = run
                        items.update(ids)
                    at = in_run.find(run, at + 1)
            found.append({"n_words": len(words), "n_hit": marks.count(1) if marks else 0,
                          "items": list(items), "marks": bytes(marks or b"")})
        return [found]

    return compute


def is_contaminated(hits: str) -> Column:
    """Hits in at least a twentieth of the words."""
    n_words, n_hit = F.col(hits)["n_words"], F.col(hits)["n_hit"]
    return (n_hit > 0) & (20 * n_hit >= n_words)


def measure(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found, hits = scan(docs.select("doc_id", F.col(text).alias("text")), benchmark)
    items = F.sort_array(F.col(hits)["items"])
    return found.select(
        "doc_id",
        F.col(hits)["n_words"].alias("n_words"),
        F.col(hits)["n_hit"].alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        is_contaminated(hits).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", spans: bool = False) -> DataFrame:
    """docs without contaminated documents; all columns stay as they are.

    With spans, the words hit in the documents that stay are cut from their texts too,
    from the first word of a covered stretch to its last.
    """
    found, hits = scan(docs, benchmark, text)
    kept = found.where(~is_contaminated(hits))
    if not spans:
        return kept.drop(hits)
    cut = StructField(free_name(found, "cut"), StringType())
    kept = append_columns(kept, [text, hits], [cut], lambda: _cut)
    changed = F.when(F.col(hits)["n_hit"] > 0, F.col(cut.name)).otherwise(F.col(text))
    return kept.withColumn(text, changed).drop(hits, cut.name)


def _cut(texts, hits):
    out = []
    for data, hit in zip(texts, hits, strict=True):
        if not hit["n_hit"]:
            out.append(None)
            continue
        places = [m.span() for m in WORD.finditer(data.lower())]
        kept, at, k, marks = [], 0, 0, hit["marks"]
        while (start := marks.find(1, k)) >= 0:
            k = marks.find(0, start)
            k = len(marks) if k < 0 else k
            kept.append(data[at:places[start][0]])
            at = places[k - 1][1]
        out.append((b"".join(kept) + data[at:]).decode("utf-8", "replace"))
    return [out]
