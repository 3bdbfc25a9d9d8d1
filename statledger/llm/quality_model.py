"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic steps.

A document's statistics (sizes, character classes, repetition) are scaled, mapped by
random cosines whose inner products approximate a Gaussian kernel, and scored linearly.
The normal equations are sums over documents: each task adds up its own part and Spark
adds the parts cell by cell, so the fit reads every labelled document and brings back one
small matrix. The scores of a fifth of the labelled documents, left out of the ridge fit,
set the isotonic curve that turns scores into probabilities.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from statledger.llm.tables import append_columns, fold
from statledger.session import written

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
FREQUENCIES = 160
WIDTH = 4.0
PENALTY = 1e-3
BINS = 512

_SYMBOLS = np.frombuffer(b"#*$%&|<>!", np.uint8)


def statistics(data: bytes) -> list:
    """Statistics of a whole text; all 0 for one without words."""
    words = data.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, size = len(words), len(data)
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int32, n)
    lines = [line for line in data.split(b"\n") if line.strip()]
    upper, lower = codes[65:91].sum(), codes[97:123].sum()
    lowered = data.lower().split()
    same = sum(map(bytes.__eq__, lowered, lowered[1:]))
    pairs = set(zip(lowered, lowered[1:], lowered[2:], strict=False))
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), len(set(lowered)) / n,
        len(pairs) / max(1, n - 2), same / n,
        upper / (upper + lower + 1.0), float(codes[_SYMBOLS].sum()) / size, float(codes[33]) / n, float(codes[124]) / n,
        float(codes[48:58].sum()) / size, float(codes[[44, 46, 59, 63]].sum()) / n,
        float(codes[128:].sum()) / size, len(lines) / n, 1.0 - len(set(lines)) / len(lines),
        float(codes[10]) / n, float((lengths <= 3).mean()), float((lengths >= 12).mean()),
    ]


N_STATISTICS = 18


def with_statistics(docs: DataFrame) -> DataFrame:
    field = StructField("stats", ArrayType(DoubleType()))
    return append_columns(docs.select("doc_id", "text"), ["text"], [field],
                          lambda: lambda texts: [[statistics(t) for t in texts]]).drop("text")


class Features:
    """Random cosines of scaled statistics, with a constant."""

    def __init__(self, mean, spread, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean), np.asarray(spread)
        self.turn = rng.normal(0, 1 / WIDTH, (N_STATISTICS, FREQUENCIES))
        self.shift = rng.uniform(0, 2 * np.pi, FREQUENCIES)

    def __call__(self, stats) -> np.ndarray:
        scaled = np.clip((np.stack(stats) - self.mean) / self.spread, -6, 6)
        waves = np.cos(scaled @ self.turn + self.shift) * np.sqrt(2 / FREQUENCIES)
        return np.hstack([waves, np.ones((len(waves), 1))])


def learn(stats: DataFrame, labels: DataFrame) -> dict:
    """Scaling, weights and isotonic steps from the labelled documents outside the held-out fold.

    Without labels of both classes there is no model, and every document scores 0.5.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    marked = marked.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = written(stats.join(marked, "doc_id").withColumn("check", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4), "labelled")
    fit, check = known.where("not check"), known.where("check")
    cells = [F.col("stats")[k] for k in range(N_STATISTICS)]
    row = fit.agg(F.count("*").alias("n"), F.avg("y").alias("rate"),
                  *[F.avg(c).alias(f"m{k}") for k, c in enumerate(cells)],
                  *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(cells)]).first()
    if not row["n"] or row["rate"] in (0.0, 1.0):
        return {}
    mean = [row[f"m{k}"] for k in range(N_STATISTICS)]
    spread = [row[f"s{k}"] + 1e-6 for k in range(N_STATISTICS)]
    weights = _ridge(fit, Features(mean, spread))
    scored = _scored(check, {"mean": mean, "spread": spread, "weights": weights})
    bins = scored.groupBy(F.round(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * BINS).alias("bin")).agg(
        F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    at, values = isotonic([b["bin"] / BINS for b in bins], [b["ones"] for b in bins], [b["n"] for b in bins], row["rate"])
    return {"mean": mean, "spread": spread, "weights": weights, "at": at, "values": values}


def _ridge(fit: DataFrame, features: Features) -> np.ndarray:
    """Weights that solve the penalised normal equations."""
    size = FREQUENCIES + 1
    upper = np.triu_indices(size)

    def partial(frames):
        gram, right, count = np.zeros((size, size)), np.zeros(size), 0
        for frame in frames:
            if len(frame):
                x = features(frame["stats"])
                gram += x.T @ x
                right += x.T @ frame["y"].to_numpy()
                count += len(frame)
        if count:
            values = np.concatenate([gram[upper], right, [count]])
            yield pd.DataFrame({"cell": np.arange(len(values)), "value": values})

    sums = fit.select("stats", "y").mapInPandas(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    values = np.array([r["value"] for r in sums.orderBy("cell").collect()])
    gram = np.zeros((size, size))
    gram[upper] = values[:len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    count = values[-1]
    penalty = np.full(size, PENALTY * count / size)
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), values[len(upper[0]):-1])


def _scored(stats: DataFrame, model: dict) -> DataFrame:
    """stats with the linear score `raw`."""
    features = Features(model["mean"], model["spread"])
    weights = model["weights"]

    def make():
        return lambda rows: [(features(rows) @ weights).tolist() if rows else []]

    return append_columns(stats, ["stats"], [StructField("raw", DoubleType())], make)


def isotonic(at: list, ones: list, counts: list, rate: float) -> tuple:
    """Places and values of the non-decreasing step curve closest to the shares of ones, by pooling
    neighbours; each pooled block counts one more document at the base rate."""
    blocks = []
    for place, one, n in zip(at, ones, counts, strict=True):
        blocks.append([place, place, one, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1][1] = last[1]
            blocks[-1][2] += last[2]
            blocks[-1][3] += last[3]
    places, values = [], []
    for low, high, one, n in blocks:
        value = (one + rate) / (n + 1)
        places += [low, high]
        values += [value, value]
    return places, np.maximum.accumulate(values).tolist() if values else []


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every document.

    A null or empty text has all statistics 0 and is scored like any other; repeated rows score alike.
    """
    stats = written(with_statistics(docs), "statistics")
    model = learn(stats, labels)
    if not model or not model["at"]:
        scored = stats.withColumn("score", F.lit(0.5))
    else:
        at, values = np.array(model["at"]), np.array(model["values"])
        features, weights = Features(model["mean"], model["spread"]), model["weights"]

        def make():
            # A small slope keeps the order within a step.
            def compute(rows):
                raw = features(rows) @ weights if rows else np.empty(0)
                level = np.interp(raw, at, values)
                return [np.clip(level + 1e-4 * np.tanh(raw), 0, 1).tolist()]

            return compute

        scored = append_columns(stats, ["stats"], [StructField("score", DoubleType())], make)
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
