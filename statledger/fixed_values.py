"""Names, codes and labels that data and results must match."""

# Label of each numeric event code.
EVENT_CODE_LABELS = {
    1: "Made Shot",
    2: "Missed Shot",
    3: "Free Throw",
    4: "Rebound",
    5: "Turnover",
    6: "Foul",
    7: "Violation",
    8: "Substitution",
    9: "Timeout",
    10: "Jump Ball",
    11: "Ejection",
    12: "Start of Period",
    13: "End of Period",
    18: "Instant Replay",
}

# Game type by the first digit of a season code.
GAME_TYPE_BY_CODE = {
    "1": "Pre Season",
    "2": "Regular Season",
    "3": "All-Star",
    "4": "Playoffs",
    "5": "Play-In Tournament",
}

# First month of a season, width of a game id, first day served by
# the newer event log, row cap and time limit of an ad-hoc query.
SEASON_FIRST_MONTH = 8
GAME_ID_WIDTH = 10
EVENT_LOG_CUTOVER = "2023-06-10"
ADHOC_ROW_CAP = 200
ADHOC_TIMEOUT_MS = 5000

# Cell texts a CSV export uses for "missing" (the defaults of
# pandas.read_csv, as its public documentation lists them).
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Functions that an ad-hoc query may call, by their names in Spark's catalog.
ADHOC_FUNCTIONS = [
    # aggregates
    "any_value", "approx_count_distinct", "avg", "bool_and", "bool_or", "corr", "count", "count_if", "first", "last",
    "max", "max_by", "median", "min", "min_by", "mode", "percentile", "percentile_approx", "stddev", "stddev_pop", "sum",
    "variance", "var_pop",
    # windows
    "cume_dist", "dense_rank", "first_value", "lag", "last_value", "lead", "nth_value", "ntile", "percent_rank", "rank",
    "row_number",
    # numbers
    "abs", "bround", "ceil", "exp", "floor", "greatest", "least", "ln", "log10", "mod", "pow", "round", "sign", "sqrt",
    "try_divide",
    # text
    "btrim", "char_length", "concat", "concat_ws", "contains", "endswith", "initcap", "left", "length", "lower", "lpad",
    "ltrim", "regexp_extract", "regexp_like", "replace", "right", "rpad", "rtrim", "split_part", "startswith", "substring",
    "trim", "upper",
    # days
    "add_months", "current_date", "date_add", "date_diff", "date_format", "date_sub", "date_trunc", "day", "dayofweek",
    "extract", "last_day", "make_date", "month", "months_between", "quarter", "to_date", "trunc", "year",
    # choices
    "coalesce", "if", "ifnull", "nullif", "nullifzero", "nvl", "nvl2", "try_to_number", "zeroifnull",
]
