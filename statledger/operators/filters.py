"""Key filters and lookups that are joins."""

from pyspark.sql import Column, DataFrame, functions as F


def with_valid_keys(df: DataFrame, columns: list, valid: DataFrame, key: str) -> DataFrame:
    """Rows whose every listed column holds a key of `valid`.

    No broadcast hint: Spark broadcasts the key column when its size allows it
    and shuffles both sides otherwise.
    """
    for column in columns:
        keys = valid.select(F.col(key).alias(f"_valid_{column}"))
        df = df.join(keys, F.col(column) == F.col(f"_valid_{column}"), "left_semi")
    return df


def distinct_opponents(df: DataFrame, home: str, away: str, valid: DataFrame, key: str) -> DataFrame:
    """Games between two different valid teams."""
    return with_valid_keys(df.where(F.col(home) != F.col(away)), [home, away], valid, key)


def new_keys(staged: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Distinct staged keys that `existing` lacks, sorted.

    Distinct first: repeats of a key go before the join, which then uses the same
    partitioning.
    """
    return staged.select(key).distinct().join(existing.select(key), key, "left_anti").orderBy(key)


def spread_key(df: DataFrame, column: str, wanted: Column) -> Column:
    """The column where `wanted` holds, else a hash of the row as a key of the column's type.

    Joined on it, rows that must match nothing don't gather at the few keys that most of
    them share. A hash may equal a key, so the join's condition has to name `wanted` too.
    """
    kind = df.schema[column].dataType
    hashed = F.pmod(F.xxhash64(*df.columns), F.lit(2**31 - 1))
    return F.when(wanted, F.col(column)).otherwise(hashed.cast(kind))


def fill_from_lookup(df: DataFrame, target: str, by: dict, lookup: DataFrame, value: str) -> DataFrame:
    """Fills a NULL `target` with lookup.value where every `by` column matches.

    `by` maps columns of df to columns of lookup, whose keys are unique. Rows
    that need no fill match nothing; a shuffle spreads them.
    """
    wanted = lookup.select(
        *[F.col(right).alias(f"_by_{right}") for right in by.values()],
        F.col(value).alias("_fill"),
    )
    match = needed = F.col(target).isNull()
    for left, right in by.items():
        match = match & (spread_key(df, left, needed) == F.col(f"_by_{right}"))
    columns = [
        F.coalesce(F.col(target), F.col("_fill")).alias(name) if name == target else F.col(name)
        for name in df.columns
    ]
    return df.join(wanted, match, "left").select(*columns)
