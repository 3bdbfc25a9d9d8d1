"""Constraints as violation reports and as a fail-fast gate."""

from pyspark.sql import Column, DataFrame, functions as F


def duplicate_keys(df: DataFrame, keys: list) -> DataFrame:
    """Keys that occur more than once, with their row count. Empty when unique."""
    return (
        df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    )


def check_violations(df: DataFrame, checks: dict) -> DataFrame:
    """One row per named check with its violations; a NULL result passes."""
    counts = df.agg(
        *[F.count_if(~F.expr(rule)).alias(name) for name, rule in checks.items()]
    )
    return _as_rows(counts, list(checks), "check_name", "n_violations")


def null_counts(df: DataFrame, columns: list) -> DataFrame:
    """One row per column with its number of NULLs, from one pass."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return _as_rows(counts, columns, "column_name", "n_nulls")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL foreign keys without a parent, with their row counts.

    Counted before the join, so a frequent key crosses the shuffle once per task.
    """
    counted = (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    )
    return counted.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def broken_rule(not_null: list, checks: dict, table: str) -> Column:
    """What is wrong with a row, NULL for a good one; a check that is NULL passes."""
    broken = [F.when(F.col(name).isNull(), F.lit(f"{table}.{name} is NULL")) for name in not_null]
    broken += [F.when(~F.expr(rule), F.lit(f"{table} violates {name}")) for name, rule in checks.items()]
    return F.coalesce(*broken, F.lit(None).cast("string"))


def enforce(df: DataFrame, message: Column, where: Column = None) -> DataFrame:
    """Fails the job that consumes the frame if any row has a message of broken_rule.

    `where` limits the test to the rows that are to enter the table.

    The test is a filter that keeps every good row: it costs no pass of its own, stays
    whatever columns are read, and nothing of a bad batch is published.
    """
    broken = message.isNotNull() if where is None else where & message.isNotNull()
    return df.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))


def _as_rows(counts: DataFrame, names: list, label: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias(label), F.col(name).alias(value)) for name in names]
    return counts.select(F.inline(F.array(*pairs)))
