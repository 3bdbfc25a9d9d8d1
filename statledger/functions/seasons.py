"""Season labels ("2025-26") and game types."""

from pyspark.sql import Column, functions as F

from statledger.fixed_values import GAME_TYPE_BY_CODE, SEASON_FIRST_MONTH
from statledger.functions.lookup import literal_map


def season_label(start_year: Column) -> Column:
    year = start_year.cast("int")
    return F.concat(year.cast("string"), F.lit("-"), F.right((year + 1).cast("string"), F.lit(2)))


def season_label_from_code(code: Column) -> Column:
    """"22025" -> "2025-26". A code without a year has no label, so its rows are rejected."""
    return season_label(F.substr(code, F.lit(2)).try_cast("int"))


def game_type_from_code(code: Column) -> Column:
    digit = F.substring(code, 1, 1)
    return F.coalesce(
        literal_map(GAME_TYPE_BY_CODE)[digit], F.concat(F.lit("Unknown ("), digit, F.lit(")"))
    )


def season_label_from_date(day: Column) -> Column:
    """Days from August on belong to the season that starts in their year."""
    start = F.when(F.month(day) >= SEASON_FIRST_MONTH, F.year(day)).otherwise(F.year(day) - 1)
    return season_label(start)
