"""Heights, durations, dates and names held as text."""

from decimal import Decimal

from pyspark.sql import Column, functions as F

from statledger.functions.values import strip

_HEIGHT = r"^\s*(\+?\d+)\s*-\s*([+-]?\d+)?\s*$"
# ISO 8601 durations without years and months, whose minutes would depend on a calendar:
# days, then after a T hours, minutes and seconds, each with or without a fraction.
_AMOUNT = r"(\d+(?:\.\d+)?)"
_DURATION = rf"^P(?!$)(?:{_AMOUNT}D)?(?:T(?:{_AMOUNT}H)?(?:{_AMOUNT}M)?(?:{_AMOUNT}S)?)?$"
# As many places as the shortest text of a double near a rounding tie has.
_EXACT = "decimal(28,18)"
_LIKE_NUMBER = r"^\s*[+-]?\.?\d[\d.eE+-]*\s*$"


def parse_height(text: Column) -> Column:
    """"6-9" -> 81 inches; no inches means 0; anything else is NULL."""
    feet = F.regexp_extract(text, _HEIGHT, 1)
    inches = F.nullif(F.regexp_extract(text, _HEIGHT, 2), F.lit(""))
    return F.when(
        text.rlike(_HEIGHT),
        feet.try_cast("int") * 12 + F.coalesce(inches, F.lit("0")).try_cast("int"),
    )


def _exact(text: Column) -> Column:
    """The number that the text spells, NULL for other texts.

    Only texts that look like one are cast: a cast that fails is slow.
    """
    return F.when(text.rlike(_LIKE_NUMBER), text.try_cast(_EXACT))


def _clock_minutes(text: Column) -> Column:
    """Minutes of "MM:SS" (all after the first colon are seconds) or of a number, unrounded."""
    colon = F.instr(text, ":")
    clock = _exact(F.substring_index(text, ":", 1)) + _exact(F.substr(text, colon + 1)) / F.lit(60)
    return F.when(colon == 0, _exact(text)).otherwise(clock)


def _duration_minutes(text: Column) -> Column:
    """Minutes of an ISO 8601 duration, unrounded; absent parts count 0, other texts are NULL."""
    # A text that is no duration keeps its P, so that its first part is no number.
    parts = F.split(F.regexp_replace(text, _DURATION, "0$1:0$2:0$3:0$4"), ":")

    def added(parts: Column) -> Column:
        days, hours, minutes, seconds = (_exact(F.get(parts, F.lit(i))) for i in range(4))
        return (days * 1440 + hours * 60 + minutes).try_cast(_EXACT) + seconds / F.lit(60)

    return _apart(parts, added)


def _one_place(minutes: Column) -> Column:
    # Decimal round() is HALF_UP.
    return F.round(minutes, 1).cast("decimal(12,1)")


_WHOLE_CLOCK = r"^[+-]?\d{1,9}:[+-]?\d{1,9}$"
# "PT34M12.00S" with whole numbers, the form that most texts have.
_WHOLE_DURATION = r"^PT(\d{1,9})M(\d{1,9})(?:\.0{1,9})?S$"


def _whole_seconds(clock: Column) -> Column:
    """Minutes with one decimal of "MM:SS" in whole numbers; NULL for other texts.

    Seconds are whole, so a tenth of a minute is six of them and needs no wide decimal.
    """
    # One pattern decides, so that no cast fails and Spark computes each of these once.
    parts = F.split(F.when(clock.rlike(_WHOLE_CLOCK), clock), ":")
    minutes, seconds = (F.get(parts, F.lit(i)).try_cast("bigint") for i in range(2))
    total = minutes * 60 + seconds
    # HALF_UP: half a tenth, which is three seconds, more.
    more = F.abs(total) + 3
    tenths = F.signum(total).cast("bigint") * ((more - more % 6) / 6).cast("bigint")
    return (tenths.cast("decimal(11,0)") * F.lit(Decimal("0.1"))).cast("decimal(12,1)")


def parse_clock_minutes(text: Column) -> Column:
    """"34:12" or "34.5" -> minutes with one decimal; negative values stay."""
    stripped = strip(text)
    return F.coalesce(_whole_seconds(stripped), _one_place(_clock_minutes(stripped)))


def parse_feed_minutes(text: Column) -> Column:
    """As parse_clock_minutes, also "PT34M12.00S" and "P1DT2H"; negative values become NULL."""
    stripped = strip(text)

    def other(text: Column) -> Column:
        minutes = F.when(F.startswith(text, F.lit("P")), _duration_minutes(text)).otherwise(_clock_minutes(text))
        return _one_place(minutes)

    clock = F.regexp_replace(stripped, _WHOLE_DURATION, "$1:$2")
    return _not_negative(F.coalesce(_whole_seconds(clock), _apart(stripped, other)))


def _apart(value: Column, function) -> Column:
    """function(value), left out of the generated code of the rows' loop.

    The JVM never compiles a method of more than 8000 bytes, and a loop that holds a long
    expression for the rare values is one, so all rows would be interpreted.
    """
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _not_negative(rounded: Column) -> Column:
    """NULL for a negative number of one decimal: all of those meet at -0.1.

    Names the number once, so that a long expression is not computed again.
    """
    below = F.lit("-0.1").cast("decimal(12,1)")
    return F.nullif(F.greatest(rounded, below), below)


def round_minutes(number: Column) -> Column:
    """Floating-point minutes with one decimal, HALF_UP; negative becomes NULL."""
    return _not_negative(_one_place(number.try_cast(_EXACT)))


# Other spellings of a day than ISO 8601, each also with a time behind it; months come before days.
_OTHER_DATES = ["M/d/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy"]


def parse_date(value: Column, strict: bool = True) -> Column:
    """Date of a text, ISO 8601 or one of the other usual spellings. Blank is NULL;
    garbage fails the job, or is NULL if not strict."""
    text = strip(value.cast("string"))
    # Other spellings are tried only for texts that are none before.
    day = F.coalesce(text.try_cast("date"), *[F.try_to_timestamp(text, F.lit(form)).cast("date") for form in _OTHER_DATES])
    if not strict:
        return day
    garbage = F.raise_error(F.concat(F.lit("no date: "), text)).cast("date")
    return F.coalesce(day, F.when(text != "", garbage))


def full_name(first: Column, last: Column) -> Column:
    return strip(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
