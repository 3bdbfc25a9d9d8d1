"""Whitening of embeddings on their leading components, by QR of blocks and a bidiagonal qd solver.

Entries become whole numbers, so counts, sums and deviations are exact. Each task reduces its
centred rows, a block at a time, to one triangular matrix; those are reduced in turn along a tree, by
Spark, to the triangle R of the whole table, whose singular vectors are the components: the
covariance, whose condition is the square, is never formed. `bidiagonal` solves R on the driver: its
size is the vectors' dimension, not the table's.
"""

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from statledger.llm.bidiagonal import right_singular

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# Beyond this an entry's whole number has no exact double; such an entry reads as not finite.
LARGEST = 2.0**42

_FAN_IN, _LEVELS = 64, 3
_SUM_BITS = 26
_EXACT = 2**62


def usable(vector: Column) -> Column:
    """True for a vector that is there, not empty and holds finite entries only."""
    entries = vector.cast("array<double>")
    return F.coalesce((F.size(entries) > 0) & F.forall(
        entries, lambda c: F.coalesce((c > F.lit(-LARGEST)) & (c < F.lit(LARGEST)), F.lit(False))), F.lit(False))


def _whole(column) -> np.ndarray:
    """The batch's vectors, all of one dimension, as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1) + SHIFT


def _of_tasks(vectors: DataFrame, schema: str, fold) -> DataFrame:
    """fold over each task's blocks of vectors, as rows; a task without vectors gives none."""
    def run(batches):
        blocks = (_whole(batch.column(0)) for batch in batches if len(batch))
        for frame in fold(blocks):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return vectors.select("vector").mapInArrow(run, schema)


def dimension(vectors: DataFrame) -> int:
    """The dimension that most vectors have, of equally common ones the highest; 0 for an empty table."""
    sizes = vectors.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def sums(vectors: DataFrame) -> tuple:
    """(count, exact sum of each dimension) of the table."""
    def fold(blocks):
        count, total = 0, 0
        for x in blocks:
            # In two halves, which a block's sums can't overflow.
            high, low = x >> _SUM_BITS, x & ((1 << _SUM_BITS) - 1)
            total = total + (high.sum(axis=0).astype(object) << _SUM_BITS) + low.sum(axis=0).astype(object)
            count += len(x)
        if count:
            yield pd.DataFrame({"place": np.arange(len(total) + 1), "value": [str(v) for v in (count, *total)]})

    parts = _of_tasks(vectors, "place long, value string", fold)
    rows = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    values = [int(r["value"]) for r in sorted(rows, key=lambda r: r["place"])]
    return (values[0], values[1:]) if values else (0, [])


def deviations(x: np.ndarray, count: int, totals: list) -> np.ndarray:
    """count * x - totals, exact: 64-bit numbers, or Python's where those are too short."""
    if (int(np.abs(x).max(initial=0)) + 1) * count < _EXACT:
        return count * x - np.array(totals, np.int64)
    return x.astype(object) * count - np.array(totals, object)


def centred(x: np.ndarray, count: int, totals: list) -> np.ndarray:
    """x less the mean, each entry rounded once or twice from its exact value."""
    return deviations(x, count, totals).astype(float) / count


def triangle(vectors: DataFrame, count: int, totals: list) -> np.ndarray:
    """R of the table's centred rows over the root of their count: R'R is the covariance."""
    size = len(totals)
    upper = np.triu_indices(size)

    def reduced(blocks):
        held = np.zeros((0, size))
        for block in blocks:
            held = np.linalg.qr(np.vstack([held, block]), mode="r")
        return np.vstack([held, np.zeros((size - len(held), size))])

    def unpacked(frame):
        for values in frame.sort_values("lot")["r"]:
            held = np.zeros((size, size))
            held[upper] = values
            yield held

    def fold(blocks):
        held = reduced(centred(x, count, totals) / np.sqrt(count) for x in blocks)
        yield pd.DataFrame({"lot": [TaskContext.get().partitionId()], "r": [held[upper]]})

    def joined(frame):
        return pd.DataFrame({"lot": [int(frame["lot"].min())], "r": [reduced(unpacked(frame))[upper]]})

    schema = "lot long, r array<double>"
    parts = _of_tasks(vectors, schema, fold)
    # A tree: no task gets more triangles than the fan-in, and the driver gets one of 262,144 tasks each.
    for level in range(_LEVELS):
        group = F.floor(F.col("lot") / _FAN_IN ** (level + 1)).alias("group")
        parts = parts.groupBy(group).applyInPandas(joined, schema)
    return reduced(unpacked(parts.toPandas()))


class Whitener:
    """Means and directions of the components: falling eigenvalues of the covariance, unit eigenvectors."""

    def __init__(self, count: int, totals: list, r: np.ndarray, most: int):
        values, directions = right_singular(r, most)
        # Of each direction and its opposite, that whose largest entry is positive.
        at = np.abs(directions).argmax(axis=0) if directions.size else np.zeros(0, int)
        directions = directions * np.sign(directions[at, np.arange(directions.shape[1])])
        self.count, self.totals, self.values = count, totals, values[:directions.shape[1]]
        self.explained = self.values / values.sum() if len(self.values) else self.values
        self.directions = directions / np.sqrt(self.values)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.count, self.totals) @ self.directions


def fitted(vectors: DataFrame, most: int = COMPONENTS) -> Whitener:
    """Of a table whose column `vector` holds vectors of one dimension, none of them null."""
    count, totals = sums(vectors)
    r = triangle(vectors, count, totals) if count else np.zeros((0, 0))
    return Whitener(count, totals, r, most)


def identity_error(vectors: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    size = len(whitener.values)

    def fold(blocks):
        gram, total = np.zeros((size, size)), np.zeros(size)
        for x in blocks:
            rows = whitener(x)
            gram += rows.T @ rows
            total += rows.sum(axis=0)
        cells = np.concatenate([gram.ravel(), total])
        yield pd.DataFrame({"cell": np.arange(len(cells)), "value": cells})

    summed = _of_tasks(vectors, "cell long, value double", fold).groupBy("cell").agg(F.sum("value").alias("value"))
    rows = summed.orderBy("cell").collect()
    cells = np.array([r["value"] for r in rows]) / whitener.count
    mean = cells[size * size:]
    covariance = cells[:size * size].reshape(size, size) - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(size)).max())


_FIELDS = [
    StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)),
    StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
]


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """The key, component, n, deviation, whitened, explained and identity_error of each vector and component.

    A vector that is null or empty, or holds a null, a NaN, an infinite entry or one of 2^42 or more, is left
    out, and so is one of another dimension than most have. Components without spread (fewer vectors than
    dimensions, equal or no vectors) have no direction and no rows. Repeated rows are vectors of their own; of
    equal eigenvalues any orthonormal set of eigenvectors is right. deviation is an exact decimal.
    """
    vectors = embeddings.select(key, F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    vectors = vectors.where(F.size("vector") == dimension(vectors))
    whitener = fitted(vectors, most)
    size = len(whitener.values)
    schema = StructType([embeddings.schema[key], *_FIELDS])
    if not size:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, whitener)
    types = [to_arrow_type(f.dataType) for f in _FIELDS]

    def run(batches):
        for batch in batches:
            x = _whole(batch.column(1))
            exact = deviations(x, whitener.count, whitener.totals)
            # Squares of up to 31 bits add up exactly in 64, some others in Python's numbers.
            if exact.dtype == object or int(np.abs(exact).max(initial=0))**2 * exact.shape[1] >= _EXACT:
                exact = exact.astype(object)
            squares = [int(v) for v in (exact * exact).sum(axis=1)]
            columns = [
                np.tile(np.arange(1, size + 1), len(x)), np.full(len(x) * size, whitener.count),
                [Decimal(v) for v in squares for _ in range(size)], whitener(x).ravel(),
                np.tile(whitener.explained, len(x)), np.full(len(x) * size, error),
            ]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), size)))
            arrays = [keys] + [pa.array(v, t) for v, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return vectors.select(key, "vector").mapInArrow(run, schema)
