"""Rolling statistics that stay parallel when one group, or one day of it, is very large."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from statledger.session import written

_RANGE, _RANK, _PLACE = "_range", "_rank", "_place"


def rolling_average(
    df: DataFrame, group: list, day: str, tie_break: str, value: str, rows: int, output: str, ranges: int = None
) -> DataFrame:
    """Average of `value` over the current and the rows-1 preceding rows of a group.

    Rows of a group are ordered by (day, tie_break), both never NULL. The rows are dealt out
    by ranges of (group, day, tie_break), so that a group, or a day, of any size is cut where
    need be; each range also gets the rows-1 rows before it, for its first rows. The input is
    read once (and once more by Spark to choose the ranges), and settled in files: the files
    are the ranges. `ranges` sets their number; Spark's shuffle partitions do otherwise.
    """
    if rows < 1:
        raise ValueError("rows must be at least 1")
    keys = [*group, day, tie_break]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *keys)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    ranged = written(dealt, "ranges").withColumn(_RANGE, number)
    # One row of carried values a range: it goes to the windows' tasks, or to all, as its size tells.
    carried = _carried(ranged, group, keys, value, rows)
    ordered = Window.partitionBy(_RANGE, *group).orderBy(day, tie_break)
    frame = ordered.rowsBetween(-(rows - 1), 0)
    own = ranged.repartition(_RANGE).withColumns({
        _RANK: F.row_number().over(ordered), "_sum": F.sum(value).over(frame), "_count": F.count(value).over(frame),
        output: F.avg(value).over(frame),
    })
    joined = own.join(carried, _RANGE, "left")
    total, kind = (field.dataType for field in df.select(F.sum(value), F.avg(value)).schema)
    first = (F.col(_RANK) < rows) & (F.size("_before") > 0)
    average = F.when(first, _with_earlier(group, rows, total).cast(kind)).otherwise(F.col(output))
    return joined.withColumn(output, average).select(*df.columns, output)


def _carried(ranged: DataFrame, group: list, keys: list, value: str, rows: int) -> DataFrame:
    """Of each range `_before`: the rows-1 rows that stand before it, in order, as structs.

    Each range gives its last rows-1 rows, limited before the shuffle; those few are numbered
    in one order, and a range takes the last ones before its own.
    """
    latest = Window.partitionBy(_RANGE).orderBy(*[F.col(key).desc() for key in keys])
    last = ranged.select(_RANGE, *dict.fromkeys([*keys, value])).withColumn(_RANK, F.row_number().over(latest))
    last = last.where(F.col(_RANK) <= max(rows - 1, 1))
    placed = last.withColumn(_PLACE, F.row_number().over(Window.orderBy(_RANGE, F.col(_RANK).desc())))
    starts = placed.groupBy(_RANGE).agg(F.min(_PLACE).alias("_start"))
    wanted = starts.where(F.col("_start") > 1).select(
        F.col(_RANGE).alias("_of"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("_start") - (rows - 1)), F.col("_start") - 1)).alias(_PLACE))
    wanted = wanted if rows > 1 else wanted.where(F.lit(False))
    entry = F.struct(_PLACE, *[F.col(name).alias(f"_g_{name}") for name in group], F.col(value).alias("_value"))
    before = wanted.join(placed, _PLACE).groupBy("_of").agg(F.sort_array(F.collect_list(entry)).alias("_before"))
    return before.withColumnRenamed("_of", _RANGE)


def _with_earlier(group: list, rows: int, kind) -> Column:
    """The average of a range's first rows, whose frames reach into the rows before the range."""
    def of_group(entry):
        return reduce(lambda a, b: a & b, [entry[f"_g_{name}"].eqNullSafe(F.col(name)) for name in group], F.lit(True))

    same = F.filter("_before", of_group)
    missing = F.lit(rows) - F.col(_RANK)
    values = F.filter(
        F.transform(F.slice(F.reverse(same), F.lit(1), missing), lambda entry: entry["_value"]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.coalesce("_sum", F.lit(0).cast(kind)), lambda a, b: (a + b).cast(kind))
    return total / F.nullif(F.col("_count") + F.size(values), F.lit(0))
