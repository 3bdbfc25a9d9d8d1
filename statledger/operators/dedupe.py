"""Keep-last de-duplication."""

from pyspark.sql import DataFrame, Window, functions as F

ORDINAL = "_ordinal"


def keep_last(df: DataFrame, keys: list, order: str = ORDINAL, prefer: str = None) -> DataFrame:
    """One row per key: the one with the greatest `order`, which is dropped.

    A `prefer` column that is not NULL beats one that is, whatever the order: the
    last usable row of a key, if it has one.
    NULL keys are equal to each other. Spark limits each key to one row per task
    before the shuffle (a partial window group limit), so a key with very many
    copies reaches its reducer as one row per task.
    """
    latest_first = [F.col(order).desc()]
    if prefer is not None:
        latest_first.insert(0, F.col(prefer).isNotNull().desc())
    # Numbers first: ids held as text share long prefixes, which sort slowly.
    kinds = dict(df.dtypes)
    by = sorted(keys, key=lambda key: kinds[key] == "string")
    window = Window.partitionBy(*by).orderBy(*latest_first)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.where(F.col("_rank") == 1).drop("_rank", order)
