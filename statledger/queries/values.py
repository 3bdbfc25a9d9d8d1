"""Value parsers over text made from the given tables."""

from pyspark.sql import functions as F

from statledger import functions as fn
from statledger.queries.registry import query
from statledger.queries.tables import day, load, sql_season


@query("q_parse_height", """
    SELECT p_partkey,
           CASE p_type WHEN 'ECONOMY' THEN 12 * (p_size // 12) + p_size % 12
                       WHEN 'SMALL' THEN 12 * p_size
                       WHEN 'MEDIUM' THEN 12 * (p_size // 12) + p_size % 12 END AS height_in
    FROM part""")
def q_parse_height(spark, sf_dir):
    """"F-I" with and without spaces or inches, and malformed texts."""
    feet, inches = F.floor(F.col("p_size") / 12).cast("string"), (F.col("p_size") % 12).cast("string")
    kind = F.col("p_type")
    text = (
        F.when(kind == "ECONOMY", F.concat(feet, F.lit("-"), inches))
        .when(kind == "SMALL", F.concat(F.col("p_size").cast("string"), F.lit("-")))
        .when(kind == "MEDIUM", F.concat(F.lit(" "), feet, F.lit(" - "), inches))
        .when(kind == "LARGE", F.col("p_size").cast("string"))
        .when(kind == "PROMO", F.lit("not-a-height"))
    )
    return load(spark, sf_dir, "part").select("p_partkey", fn.parse_height(text).alias("height_in"))


def duration_text():
    """Seven spellings of a duration, chosen by line number."""
    minutes = F.col("l_quantity").cast("int").cast("string")
    seconds = F.lpad(F.month(day("l_shipdate")).cast("string"), 2, "0")
    decimal = (F.col("l_extendedprice").cast("decimal(12,2)") / 1000).cast("decimal(12,5)")
    number = F.col("l_linenumber")
    return (
        F.when(number == 1, F.concat(F.lit("PT"), minutes, F.lit("M"), seconds, F.lit(".00S")))
        .when(number == 2, F.concat(minutes, F.lit(":"), seconds))
        .when(number == 3, F.concat(F.lit(" "), decimal.cast("string")))
        .when(number == 4, F.lit(" "))
        .when(number == 5, F.concat(F.lit("-"), minutes, F.lit(":"), seconds))
        .when(number == 6, F.lit("DNP"))
        .when(number == 7, F.lit("PT"))
    )


_MINUTE_TENTHS = """CASE l_linenumber
             WHEN 1 THEN CAST(l_quantity AS BIGINT) * 10 + (month(CAST(l_shipdate AS DATE)) + 3) // 6
             WHEN 2 THEN CAST(l_quantity AS BIGINT) * 10 + (month(CAST(l_shipdate AS DATE)) + 3) // 6
             WHEN 3 THEN (CAST(round(l_extendedprice * 100) AS BIGINT) + 5000) // 10000 END"""
# Tenths of the feed reading of duration_text(); the clock reading follows from it.
SQL_FEED_TENTHS = f"coalesce({_MINUTE_TENTHS}, CASE l_linenumber WHEN 7 THEN 0 END)"
# -MM:SS reads as -MM plus SS seconds; ties go away from zero.
_CLOCK_TENTHS = f"""CASE l_linenumber WHEN 1 THEN NULL
             WHEN 5 THEN -((CAST(l_quantity AS BIGINT) * 60 - month(CAST(l_shipdate AS DATE)) + 3) // 6)
             ELSE ({_MINUTE_TENTHS}) END"""
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


@query("q_parse_duration", f"""
    SELECT {_LINE}, CAST(({_CLOCK_TENTHS}) AS DOUBLE) / 10 AS clock_minutes,
           CAST(({SQL_FEED_TENTHS}) AS DOUBLE) / 10 AS feed_minutes
    FROM lineitem""")
def q_parse_duration(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(*_LINE.split(", "), duration_text().alias("minutes"))
    return rows.select(
        *_LINE.split(", "),
        fn.parse_clock_minutes(F.col("minutes")).cast("double").alias("clock_minutes"),
        fn.parse_feed_minutes(F.col("minutes")).cast("double").alias("feed_minutes"),
    )


@query("q_round_minutes", f"""
    SELECT {_LINE}, CAST((CAST(round(l_extendedprice * 100) AS BIGINT) - 1000000 + 5000) // 10000 AS DOUBLE) / 10 AS minutes
    FROM lineitem WHERE CAST(round(l_extendedprice * 100) AS BIGINT) - 1000000 + 5000 >= 0
    UNION ALL
    SELECT {_LINE}, CASE WHEN CAST(round(l_extendedprice * 100) AS BIGINT) - 1000000 + 5000 = 0 THEN 0.0 END
    FROM lineitem WHERE CAST(round(l_extendedprice * 100) AS BIGINT) - 1000000 + 5000 < 0""")
def q_round_minutes(spark, sf_dir):
    """Float minutes, some negative, rounded half up to one place."""
    minutes = (F.col("l_extendedprice") - 10000) / 1000
    return load(spark, sf_dir, "lineitem").select(
        *_LINE.split(", "), fn.round_minutes(minutes).cast("double").alias("minutes")
    )


@query("q_season_label_date", f"""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day, {sql_season("CAST(o_orderdate AS DATE)")} AS season_label
    FROM orders""")
def q_season_label_date(spark, sf_dir):
    text = F.col("o_orderdate").cast("string")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", fn.parse_date(text).alias("order_day"),
        fn.season_label_from_date(fn.parse_date(text)).alias("season_label"),
    )


@query("q_season_label_code", """
    SELECT o_orderkey,
           year(o_orderdate) || '-' || right(CAST(year(o_orderdate) + 1 AS VARCHAR), 2) AS season_label,
           CASE left(o_orderpriority, 1) WHEN '1' THEN 'Pre Season' WHEN '2' THEN 'Regular Season'
                WHEN '3' THEN 'All-Star' WHEN '4' THEN 'Playoffs' WHEN '5' THEN
                CASE WHEN o_orderstatus = 'O' THEN 'Play-In Tournament' ELSE 'Unknown (9)' END END AS game_type
    FROM orders""")
def q_season_label_code(spark, sf_dir):
    digit = F.substring("o_orderpriority", 1, 1)
    kind = F.when((digit == "5") & (F.col("o_orderstatus") != "O"), F.lit("9")).otherwise(digit)
    code = F.concat(kind, F.year("o_orderdate").cast("string"))
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", fn.season_label_from_code(code).alias("season_label"),
        fn.game_type_from_code(code).alias("game_type"),
    )


@query("q_pad_id", """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN o_orderkey || '-00000000000'
                ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS game_id
    FROM orders""")
def q_pad_id(spark, sf_dir):
    """Short ids are padded; ids over the width stay whole."""
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(key, F.lit("-00000000000"))).otherwise(key)
    return load(spark, sf_dir, "orders").select("o_orderkey", fn.pad_id(text).alias("game_id"))


@query("q_full_name", """
    SELECT p_partkey, trim(coalesce(CASE WHEN p_type <> 'PROMO' THEN split_part(p_name, ' ', 1) END, '') || ' '
           || coalesce(CASE WHEN p_type NOT IN ('LARGE', 'PROMO') OR p_size > 25 THEN split_part(p_name, ' ', 2) END, '')) AS full_name
    FROM part""")
def q_full_name(spark, sf_dir):
    kind = F.col("p_type")
    first = F.when(kind != "PROMO", F.split_part("p_name", F.lit(" "), F.lit(1)))
    last = F.when(
        ~kind.isin("LARGE", "PROMO") | (F.col("p_size") > 25),
        F.split_part("p_name", F.lit(" "), F.lit(2)),
    )
    return load(spark, sf_dir, "part").select("p_partkey", fn.full_name(first, last).alias("full_name"))


@query("q_zero_as_null", """
    SELECT event_id, nullif(user_id, 0) AS player_id,
           nullif(CAST(round_even(value / 10, 0) AS BIGINT), 0) AS player2_id
    FROM events""")
def q_zero_as_null(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", fn.zero_as_null(F.col("user_id")).alias("player_id"),
        fn.zero_as_null(F.col("value") / 10).alias("player2_id"),
    )


@query("q_code_labels", """
    SELECT event_id,
           CASE event_type WHEN 'click' THEN 'Made Shot' WHEN 'view' THEN 'Missed Shot'
                WHEN 'purchase' THEN 'Instant Replay' WHEN 'signup' THEN 'Unknown (999)' ELSE 'Unknown' END AS from_code,
           CASE event_type WHEN 'signup' THEN 'Unknown' WHEN 'error' THEN 'Unknown' ELSE event_type END AS from_text
    FROM events""")
def q_code_labels(spark, sf_dir):
    code = (
        F.when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "view", 2)
        .when(F.col("event_type") == "purchase", 18)
        .when(F.col("event_type") == "signup", 999)
    )
    text = F.when(F.col("event_type") == "signup", "  ").when(
        F.col("event_type") != "error", F.concat(F.lit(" "), F.col("event_type"))
    )
    return load(spark, sf_dir, "events").select(
        "event_id", fn.code_label(code).alias("from_code"),
        fn.event_type_or_unknown(text).alias("from_text"),
    )


@query("q_coalesce_roles", """
    SELECT event_id,
           CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN user_id
                ELSE nullif(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) END AS player2_id,
           CASE event_type WHEN 'click' THEN event_type WHEN 'view' THEN props ELSE 'neutral' END AS description,
           CASE WHEN event_type = 'error' THEN event_id ELSE CAST(round_even(value, 0) AS BIGINT) END AS sequence
    FROM events WHERE user_id > 0
    UNION ALL
    SELECT event_id,
           CASE WHEN event_type IN ('click', 'view') THEN NULL
                ELSE nullif(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) END,
           CASE event_type WHEN 'click' THEN event_type WHEN 'view' THEN props ELSE 'neutral' END,
           CASE WHEN event_type = 'error' THEN event_id ELSE CAST(round_even(value, 0) AS BIGINT) END
    FROM events WHERE user_id = 0""")
def q_coalesce_roles(spark, sf_dir):
    """Shared role columns (a first "0" hides the second), texts and sequences."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    first = F.when(kind == "click", "0").when(kind != "view", k)
    second = F.col("user_id").cast("string")
    order_number = F.when(kind != "error", F.col("value"))
    return load(spark, sf_dir, "events").select(
        "event_id", fn.role_slot(first, second).alias("player2_id"),
        fn.first_present(
            F.when(kind == "click", kind), F.when(kind == "view", F.col("props")), F.lit("neutral")
        ).alias("description"),
        fn.nullable_int(
            fn.first_present(order_number, F.col("event_id").cast("double"))
        ).alias("sequence"),
    )


@query("q_score_split", """
    SELECT event_id,
           CASE event_type WHEN 'error' THEN NULL ELSE user_id END AS score_away,
           CASE WHEN event_type IN ('error', 'signup') THEN NULL
                ELSE CAST(floor(value) AS BIGINT) END AS score_home
    FROM events""")
def q_score_split(spark, sf_dir):
    """"AWAY - HOME"; signups lack the second part, errors lack both."""
    user, value = F.col("user_id").cast("string"), F.floor("value").cast("string")
    score = F.when(F.col("event_type") == "signup", user).when(
        F.col("event_type") != "error", F.concat(user, F.lit(" - "), value)
    )
    sides = {"score_away": 1, "score_home": 2}
    return load(spark, sf_dir, "events").select(
        "event_id",
        *[
            fn.nullable_int(fn.number_from_text(fn.score_part(score, part))).alias(name)
            for name, part in sides.items()
        ],
    )


@query("q_tristate", """
    SELECT event_id, CASE event_type WHEN 'click' THEN TRUE WHEN 'view' THEN FALSE END AS shot_made FROM events""")
def q_tristate(spark, sf_dir):
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit(": Made "), F.col("props")))
        .when(kind == "view", F.lit("MISSED"))
        .when(kind == "error", F.lit("other"))
    )
    return load(spark, sf_dir, "events").select("event_id", fn.shot_made(text).alias("shot_made"))


@query("q_ilike_variants", """
    SELECT p_partkey, p_name, p_type FROM part
    WHERE p_name ILIKE '%Ring%' OR p_type ILIKE 'stand%' OR p_type IN ('PROMO', 'SMALL')""")
def q_ilike_variants(spark, sf_dir):
    wanted = (
        F.col("p_name").ilike("%Ring%")
        | F.col("p_type").ilike("stand%")
        | F.col("p_type").isin("PROMO", "SMALL")
    )
    return load(spark, sf_dir, "part").where(wanted).select("p_partkey", "p_name", "p_type")


@query("q_json_safe", """
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
           strftime(o_orderdate, '%Y-%m-%d') AS order_day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered_at,
           o_totalprice
    FROM orders""")
def q_json_safe(spark, sf_dir):
    return fn.json_safe(load(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        day("o_orderdate").alias("order_day"), F.col("o_orderdate").alias("ordered_at"), "o_totalprice",
    ))
