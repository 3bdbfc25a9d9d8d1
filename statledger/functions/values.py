"""Missing values, numbers and ids."""

from pyspark.sql import Column, functions as F

from statledger.fixed_values import GAME_ID_WIDTH, MISSING_TOKENS

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_missing(number: Column) -> Column:
    """True for NULL and for a floating-point NaN."""
    return number.isNull() | F.isnan(number)


def nan_as_null(number: Column) -> Column:
    return F.nullif(number, F.lit(float("nan")))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (plain trim takes spaces only)."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def drop_missing_tokens(text: Column) -> Column:
    """NULL where a CSV cell holds one of the usual spellings of "missing"."""
    return F.when(~text.isin(MISSING_TOKENS), text)


def number_from_text(text: Column, plain: Column = None) -> Column:
    """Double, or NULL where the text is no plain number.

    The pattern keeps out what only the JVM reads as a number ("1d", "0x1p3"). Where `plain` says that the text
    has digits, signs and points only, it can't be one of those and isn't matched.
    """
    number = text.rlike(_NUMBER)
    return F.when(number if plain is None else plain | number, text.try_cast("double"))


def nullable_int(number: Column) -> Column:
    """Nearest integer, ties to even; NULL for NULL, NaN and infinities."""
    return F.bround(number).try_cast("bigint")


def zero_as_null(number: Column) -> Column:
    """Id 0 stands for "nobody" in event rows."""
    return F.nullif(nullable_int(number), F.lit(0).cast("bigint"))


def pad_id(text: Column, width: int = GAME_ID_WIDTH) -> Column:
    """Left-pads with zeros. Longer ids stay whole (plain lpad would cut them)."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0. Integers become decimals first."""
    exact = "decimal(20,0)"
    return part.cast(exact) / F.nullif(whole.cast(exact), F.lit(0).cast(exact))
