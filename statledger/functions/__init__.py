"""Column expressions. Each takes Columns and returns a Column; none is a UDF."""

from statledger.functions.events import (
    code_label,
    event_type_or_unknown,
    first_present,
    role_slot,
    score_part,
    shot_made,
)
from statledger.functions.output import json_safe
from statledger.functions.parsing import (
    full_name,
    parse_clock_minutes,
    parse_date,
    parse_feed_minutes,
    parse_height,
    round_minutes,
)
from statledger.functions.seasons import (
    game_type_from_code,
    season_label,
    season_label_from_code,
    season_label_from_date,
)
from statledger.functions.values import (
    blank_as_null,
    drop_missing_tokens,
    is_missing,
    nan_as_null,
    nullable_int,
    number_from_text,
    pad_id,
    ratio,
    strip,
    zero_as_null,
)

__all__ = [
    "blank_as_null", "code_label", "drop_missing_tokens", "event_type_or_unknown",
    "first_present", "full_name", "game_type_from_code", "is_missing", "json_safe",
    "nan_as_null",    "nullable_int", "number_from_text", "pad_id", "parse_clock_minutes", "parse_date",
    "parse_feed_minutes", "parse_height", "ratio", "role_slot", "round_minutes",
    "score_part", "season_label", "season_label_from_code", "season_label_from_date",
    "shot_made", "strip", "zero_as_null",
]
