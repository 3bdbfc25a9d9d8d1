"""Shared pieces: input tables, document folds, ASCII lower-casing and Arrow batch mapping."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Word patterns of the contracts: letters, digits and anything beyond ASCII; or runs between ASCII space.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 22


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo folds; null for a null id, which belongs to no fold."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def held_out(doc_id: str, folds: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else as it is; null reads as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def values_of(batch: pa.RecordBatch, name: str) -> list:
    """The column as Python values; texts as UTF-8 bytes, b"" for null."""
    values = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(values.type):
        values = values.cast(pa.binary())
    elif pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    else:
        return values.to_pylist()
    return [b"" if v is None else v for v in values.to_pylist()]


def pieces(batches, name: str, most: int = PIECE_BYTES):
    """The batches cut by rows into pieces of about `most` bytes in the named column.

    What a task holds of texts as Python values then doesn't depend on Spark's batches. A
    text longer than that is a piece of its own, whole; columns without text or bytes stay as they are.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        if not any(test(column.type) for test in (
                pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        lots = np.cumsum(sizes, dtype=np.int64) // most
        starts = np.append(0, np.flatnonzero(np.diff(lots)) + 1)
        for start, end in zip(starts, np.append(starts[1:], len(batch)), strict=True):
            yield batch.slice(int(start), int(end - start))


def append_columns(df: DataFrame, inputs: list, fields: list, make) -> DataFrame:
    """df with more columns, computed by Arrow batches.

    fields are StructFields with names that df lacks. make() runs once in each task and
    returns a function from the lists of the input columns to a list for each field.
    """
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        compute = make()
        for batch in pieces(batches, inputs[0]):
            lists = compute(*[values_of(batch, name) for name in inputs])
            arrays = [pa.array(v, t) for v, t in zip(lists, types, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, batch.schema.names + names)

    return df.mapInArrow(run, StructType(df.schema.fields + fields))
