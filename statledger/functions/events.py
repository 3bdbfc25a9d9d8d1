"""Values of event-log rows."""

from pyspark.sql import Column, functions as F

from statledger.fixed_values import EVENT_CODE_LABELS
from statledger.functions.lookup import literal_map
from statledger.functions.values import number_from_text, strip, zero_as_null


def code_label(code: Column) -> Column:
    """Label of an event code; "Unknown (n)" for other codes, "Unknown" for none."""
    number = code.cast("int")
    return F.coalesce(
        literal_map(EVENT_CODE_LABELS)[number],
        F.concat(F.lit("Unknown ("), number.cast("string"), F.lit(")")),
        F.lit("Unknown"),
    )


def event_type_or_unknown(text: Column) -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit("Unknown"))


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def score_part(score: Column, position: int) -> Column:
    """Text of side 1 (away) or 2 (home) of "AWAY - HOME"; NULL where absent."""
    return F.try_element_at(F.split(score, " - "), F.lit(position))


def role_slot(first: Column, second: Column) -> Column:
    """Player id of a role that two text columns share.

    The choice precedes the number and zero tests, so a first column that holds
    "0" hides the second.
    """
    return zero_as_null(number_from_text(F.coalesce(first, second)))


def shot_made(result: Column) -> Column:
    lowered = F.lower(result)
    return F.when(F.contains(lowered, F.lit("made")), F.lit(True)).when(
        F.contains(lowered, F.lit("missed")), F.lit(False)
    )
