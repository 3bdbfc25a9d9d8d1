"""Whole cleaning jobs on raw frames made from the given tables."""

from pyspark.sql import functions as F

from statledger.operators.dedupe import ORDINAL
from statledger.plans import clean
from statledger.queries.registry import query
from statledger.queries.tables import (
    SQL_LINE_ORDER_DESC,
    SQL_RAW_GAMES,
    SQL_TEAMS,
    day,
    line_order,
    load,
    raw_games,
    sql_season,
    teams,
)
from statledger.queries.values import SQL_FEED_TENTHS, duration_text

_SQL_REAL_GAMES = f"""
    SELECT * FROM ({SQL_RAW_GAMES})
    WHERE team_id_home IN (SELECT nba_team_id FROM ({SQL_TEAMS}))
      AND team_id_away IN (SELECT nba_team_id FROM ({SQL_TEAMS})) AND team_id_home <> team_id_away
    QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY edition DESC) = 1"""


def _int(column):
    return f"CAST(round_even({column}, 0) AS INT)"


SQL_CLEAN_GAMES = f"""
    SELECT game_id AS nba_game_id, game_date, season_type AS game_type,
           team_id_home AS home_nba_team_id, team_id_away AS away_nba_team_id,
           {_int('pts_home')} AS home_score, {_int('pts_away')} AS away_score,
           right(season_id, 4) || '-' || right(CAST(CAST(right(season_id, 4) AS INT) + 1 AS VARCHAR), 2) AS season_label
    FROM ({_SQL_REAL_GAMES})"""


@query("q_clean_games", SQL_CLEAN_GAMES)
def q_clean_games(spark, sf_dir):
    return clean.clean_games(raw_games(spark, sf_dir), teams(spark, sf_dir))


@query("q_clean_games_backfill", f"""
    SELECT lpad(game_id, 10, '0') AS nba_game_id, game_date, season_type AS game_type,
           team_id_home AS home_nba_team_id, team_id_away AS away_nba_team_id,
           {_int('pts_home')} AS home_score, {_int('pts_away')} AS away_score,
           {sql_season('game_date')} AS season_label
    FROM ({_SQL_REAL_GAMES})""")
def q_clean_games_backfill(spark, sf_dir):
    raw = raw_games(spark, sf_dir).select(
        F.col("game_id").alias("gameId"), F.concat("game_date", F.lit(" 19:30:00")).alias("gameDate"),
        F.col("season_type").alias("gameType"), F.col("team_id_home").alias("hometeamId"),
        F.col("team_id_away").alias("awayteamId"), F.col("pts_home").alias("homeScore"),
        F.col("pts_away").alias("awayScore"), ORDINAL,
    )
    return clean.clean_games_backfill(raw, teams(spark, sf_dir))


SQL_TEAM_LINES = f"""
    SELECT game_id AS nba_game_id, team_id_home AS nba_team_id, {_int('reb_home')} AS rebounds,
           {_int('ast_home')} AS assists, {_int('tov_home')} AS turnovers, {_int('pts_home')} AS points
    FROM ({_SQL_REAL_GAMES})
    UNION ALL
    SELECT game_id, team_id_away, {_int('reb_away')}, {_int('ast_away')}, {_int('tov_away')}, {_int('pts_away')}
    FROM ({_SQL_REAL_GAMES})"""


@query("q_wide_to_long", SQL_TEAM_LINES)
def q_wide_to_long(spark, sf_dir):
    return clean.clean_team_game_stats(raw_games(spark, sf_dir), teams(spark, sf_dir))


def _team_rows(spark, sf_dir):
    """Feed rows: the odd lines of an order are the home side, the even ones the away side.

    Orders of one line are one-sided; orders of several have several rows per side.
    """
    rows = load(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("GAME_ID"),
        day("l_shipdate").cast("string").alias("GAME_DATE"),
        F.col("l_suppkey").alias("TEAM_ID"),
        F.concat(F.lit("2"), F.year("l_shipdate").cast("string")).alias("SEASON_ID"),
        F.when(F.col("l_linenumber") % 2 == 0, "AAA @ BBB")
        .when(F.col("l_returnflag") != "R", "AAA vs. BBB")
        .alias("MATCHUP"),
        F.col("l_quantity").alias("PTS"), (F.col("l_quantity") / 2).alias("REB"),
        F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("AST"),
        F.month(day("l_shipdate")).cast("double").alias("TOV"), line_order(),
    )


_SQL_LAST_SIDES = f"""
    SELECT *, l_linenumber % 2 AS home FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY {SQL_LINE_ORDER_DESC}) = 1"""


@query("q_pair_rows", f"""
    SELECT lpad(CAST(h.l_orderkey AS VARCHAR), 10, '0') AS nba_game_id, CAST(h.l_shipdate AS DATE) AS game_date,
           'Regular Season' AS game_type, CAST(h.l_suppkey AS INT) AS home_nba_team_id,
           CAST(a.l_suppkey AS INT) AS away_nba_team_id, CAST(h.l_quantity AS INT) AS home_score,
           CAST(a.l_quantity AS INT) AS away_score,
           year(h.l_shipdate) || '-' || right(CAST(year(h.l_shipdate) + 1 AS VARCHAR), 2) AS season_label
    FROM ({_SQL_LAST_SIDES}) h JOIN ({_SQL_LAST_SIDES}) a
      ON a.l_orderkey = h.l_orderkey AND h.home = 1 AND a.home = 0""")
def q_pair_rows(spark, sf_dir):
    return clean.clean_feed_games(_team_rows(spark, sf_dir))


@query("q_feed_team_stats", f"""
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS nba_game_id, CAST(l_suppkey AS INT) AS nba_team_id,
           {_int('l_quantity / 2')} AS rebounds, CAST(nullif(l_quantity, 7) AS INT) AS assists,
           month(CAST(l_shipdate AS DATE)) AS turnovers, CAST(l_quantity AS INT) AS points
    FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {SQL_LINE_ORDER_DESC}) = 1""")
def q_feed_team_stats(spark, sf_dir):
    return clean.clean_feed_team_stats(_team_rows(spark, sf_dir))


@query("q_team_stats_backfill", f"""
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS nba_game_id, CAST(l_suppkey AS INT) AS nba_team_id,
           {_int('l_quantity / 2')} AS rebounds, l_linenumber AS assists,
           CAST(NULL AS INT) AS turnovers, CAST(l_quantity AS INT) AS points
    FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey
                               ORDER BY {SQL_LINE_ORDER_DESC}) = 1""")
def q_team_stats_backfill(spark, sf_dir):
    raw = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("gameId"), F.col("l_suppkey").alias("teamId"),
        (F.col("l_quantity") / 2).alias("reboundsTotal"),
        F.col("l_linenumber").cast("double").alias("assists"),
        F.lit(None).cast("double").alias("turnovers"), F.col("l_quantity").alias("teamScore"), line_order(),
    )
    return clean.clean_team_game_stats_backfill(raw)


def _stats():
    quantity, number = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return {
        "points": quantity, "reboundsTotal": quantity / 2,
        "assists": F.nullif(quantity, F.lit(7.0)), "steals": number,
        "blocks": F.lit(None).cast("double"), "turnovers": F.month("l_shipdate").cast("double"),
        "fieldGoalsMade": quantity / 4, "fieldGoalsAttempted": quantity,
        "threePointersMade": F.lit(0.0), "threePointersAttempted": F.lit(0.0),
        "freeThrowsMade": number / 2, "freeThrowsAttempted": number,
    }


_SQL_STATS = f"""
           CAST(l_quantity AS INT) AS points, {_int('l_quantity / 2')} AS rebounds,
           CAST(nullif(l_quantity, 7) AS INT) AS assists, l_linenumber AS steals, CAST(NULL AS INT) AS blocks,
           month(CAST(l_shipdate AS DATE)) AS turnovers, {_int('l_quantity / 4')} AS fg_made,
           CAST(l_quantity AS INT) AS fg_attempted, 0 AS fg3_made, 0 AS fg3_attempted,
           {_int('l_linenumber / 2.0')} AS ft_made, l_linenumber AS ft_attempted"""
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _minutes_as_double(rows):
    return rows.withColumn("minutes", F.col("minutes").cast("double"))


@query("q_clean_fact", f"""
    WITH names AS (
      SELECT p_brand, p_type, nullif(p_size, 1) AS team_id FROM part
      QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) = 1),
    last AS (
      SELECT l.*, p_brand, p_type, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS given
      FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE l_quantity <> 7
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {SQL_LINE_ORDER_DESC}) = 1)
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS nba_game_id, l_linenumber AS nba_player_id,
           CAST(coalesce(given, team_id) AS INT) AS nba_team_id,
           CASE WHEN l_quantity <> 13 THEN CAST(({_CENTS} + 5000) // 10000 AS DOUBLE) / 10 END AS minutes,
           {_SQL_STATS}
    FROM last LEFT JOIN names ON given IS NULL AND last.p_brand = names.p_brand
         AND last.p_type = names.p_type AND names.team_id IS NOT NULL""")
def q_clean_fact(spark, sf_dir):
    """Batch box scores: blank minutes drop the row first, negative minutes keep it."""
    part = load(spark, sf_dir, "part")
    raw = load(spark, sf_dir, "lineitem").join(
        part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey"
    ).select(
        F.col("l_orderkey").cast("string").alias("gameId"), F.col("l_linenumber").cast("bigint").alias("personId"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("playerteamId"),
        F.col("p_brand").alias("playerteamCity"), F.col("p_type").alias("playerteamName"),
        F.when(F.col("l_quantity") == 13, F.lit(-5.0))
        .when(F.col("l_quantity") != 7, F.col("l_extendedprice") / 1000)
        .alias("numMinutes"),
        *[column.alias(name) for name, column in _stats().items()], line_order(),
    )
    histories = part.select(
        F.col("p_brand").alias("teamCity"), F.col("p_type").alias("teamName"),
        F.nullif(F.col("p_size"), F.lit(1)).cast("bigint").alias("teamId"), F.col("p_partkey").alias(ORDINAL),
    )
    return _minutes_as_double(clean.clean_player_game_stats(raw, clean.team_name_lookup(histories)))


def sql_feed_lines(team):
    """Clean rows of feed_lines()."""
    return f"""
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS nba_game_id, CAST(l_partkey AS INT) AS nba_player_id,
           CAST({team} AS INT) AS nba_team_id,
           CAST(({SQL_FEED_TENTHS}) AS DOUBLE) / 10 AS minutes,
           {_SQL_STATS}
    FROM lineitem WHERE l_linenumber IN (1, 2, 3, 7)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {SQL_LINE_ORDER_DESC}) = 1"""


@query("q_clean_feed_fact", sql_feed_lines("l_suppkey"))
def q_clean_feed_fact(spark, sf_dir):
    """Feed box scores: minutes are parsed first, then blank, bad and negative ones drop the row."""
    return _minutes_as_double(clean.clean_feed_player_stats(feed_lines(spark, sf_dir, "l_suppkey")))


def feed_lines(spark, sf_dir, team, *more):
    """lineitem as player rows of the feed, with the given column as the team, and more columns."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("gameId"), F.col("l_partkey").alias("personId"),
        F.col(team).cast("bigint").alias("teamId"), duration_text().alias("minutes"),
        *[column.alias(name) for name, column in _stats().items()], line_order(), *more,
    )


@query("q_left_enrich", """
    SELECT CAST(c_custkey AS INT) AS nba_player_id, c_name AS full_name,
           CASE WHEN o_orderkey IS NOT NULL THEN CAST(o_orderdate AS DATE) END AS birthdate,
           CASE WHEN o_orderkey IS NOT NULL THEN 72 + CAST(left(o_orderpriority, 1) AS INT) END AS height_in,
           CASE WHEN o_orderkey IS NOT NULL THEN CAST(round_even(floor(o_totalprice / 1000) * 0.5, 0) AS INT) END AS weight_lb,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END AS draft_year
    FROM customer LEFT JOIN (
      SELECT * FROM orders WHERE o_totalprice > 300000
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    ON o_custkey = c_custkey""")
def q_left_enrich(spark, sf_dir):
    """Every customer with the last large order as the bio, where there is one."""
    players = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_custkey").alias(ORDINAL)
    )
    bio = load(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000).select(
        F.col("o_custkey").alias("person_id"), day("o_orderdate").cast("string").alias("birthdate"),
        F.concat(F.lit("6-"), F.substring("o_orderpriority", 1, 1)).alias("height"),
        (F.floor(F.col("o_totalprice") / 1000) * 0.5).cast("string").alias("weight"),
        F.when(F.col("o_orderstatus") == "P", "Undrafted").otherwise(F.year("o_orderdate").cast("string")).alias("draft_year"),
        F.col("o_orderkey").alias(ORDINAL),
    )
    return clean.clean_players(players, bio)


@query("q_players_backfill", """
    SELECT CAST(p_partkey AS INT) AS nba_player_id, trim(coalesce(CASE WHEN p_type <> 'PROMO' THEN split_part(p_name, ' ', 1) END, '')
             || ' ' || split_part(p_name, ' ', 2)) AS full_name,
           CAST(NULL AS DATE) AS birthdate, p_size AS height_in,
           CAST(floor(p_retailprice) AS INT) AS weight_lb, CAST(NULL AS INT) AS draft_year
    FROM part""")
def q_players_backfill(spark, sf_dir):
    raw = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("personId"), F.lit(None).cast("string").alias("birthDate"),
        F.col("p_size").cast("bigint").alias("heightInches"),
        F.floor("p_retailprice").alias("bodyWeightLbs"), F.lit(None).cast("bigint").alias("draftYear"),
        F.when(F.col("p_type") != "PROMO", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("firstName"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("lastName"), F.col("p_partkey").alias(ORDINAL),
    )
    return clean.clean_players_backfill(raw)


_CUT = "2024-01-15"


def old_events(spark, sf_dir, until=_CUT):
    """Events before the cut in the shape of the older log: one per user and hour."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, sf_dir, "events").where(
        F.col("ts") < F.lit(until).cast("timestamp_ntz")
    ).select(
        F.col("user_id").cast("string").alias("game_id"),
        (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("eventnum"),
        F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 5)
        .when(kind == "signup", 12).otherwise(99).alias("eventmsgtype"),
        (F.floor(F.hour("ts") / 6) + 1).cast("int").alias("period"),
        F.concat(F.hour("ts").cast("string"), F.lit(":00")).alias("pctimestring"),
        F.when(kind == "click", F.col("props")).alias("homedescription"),
        F.when(kind == "view", kind).alias("visitordescription"),
        F.when(kind == "error", F.lit("")).otherwise(F.lit("neutral")).alias("neutraldescription"),
        F.when(kind == "error", F.lit("5")).when(
            kind != "signup", F.concat(k.cast("string"), F.lit(" - "), F.floor("value").cast("string"))
        ).alias("score"),
        F.col("user_id").alias("player1_id"), k.alias("player1_team_id"),
        F.floor("value").alias("player2_id"), F.lit(0).cast("bigint").alias("player3_id"),
        F.struct("ts", "event_id").alias(ORDINAL),
    )


def new_events(spark, sf_dir, since=_CUT):
    """Events from the cut on in the shape of the newer log."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    whole = F.floor("value").cast("string")
    return load(spark, sf_dir, "events").where(
        F.col("ts") >= F.lit(since).cast("timestamp_ntz")
    ).select(
        F.col("user_id").cast("string").alias("gameId"),
        F.when(kind != "click", (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("double")).alias("orderNumber"),
        (F.dayofmonth("ts") * 24).cast("double").alias("actionNumber"),
        (F.floor(F.hour("ts") / 6) + 1).cast("double").alias("period"),
        F.lit("PT08M15.00S").alias("clock"),
        F.when(kind == "error", F.lit(" ")).when(kind != "signup", kind).alias("actionType"),
        F.nullif(kind, F.lit("view")).alias("subType"), F.col("props").alias("description"),
        k.alias("teamId"), F.col("user_id").cast("string").alias("personId"),
        F.when(kind == "click", F.lit("0")).when(kind == "view", k).alias("assistPersonId"),
        whole.alias("stealPersonId"), F.when(kind == "error", F.lit("x")).alias("blockPersonId"),
        k.alias("foulDrawnPersonId"), F.col("value").alias("scoreHome"), (F.col("value") / 2).alias("scoreAway"),
        (F.floor("value") / 4).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
        F.floor("value").cast("double").alias("shotDistance"),
        F.when(kind == "click", "Made").when(kind == "view", ": Missed").alias("shotResult"),
        F.struct("ts", "event_id").alias(ORDINAL),
    )


_SQL_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_SQL_V = "CAST(floor(value) AS INT)"


def sql_old_events(until=_CUT):
    return f"""
    SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS nba_game_id, day(ts) * 24 + hour(ts) AS sequence,
           CAST(hour(ts) // 6 + 1 AS SMALLINT) AS period, hour(ts) || ':00' AS clock,
           CASE event_type WHEN 'click' THEN 'Made Shot' WHEN 'view' THEN 'Missed Shot' WHEN 'purchase' THEN 'Turnover'
                WHEN 'signup' THEN 'Start of Period' ELSE 'Unknown (99)' END AS event_type,
           CAST(NULL AS VARCHAR) AS sub_type,
           CASE event_type WHEN 'click' THEN props WHEN 'view' THEN 'view' WHEN 'error' THEN NULL
                ELSE 'neutral' END AS description,
           CAST(nullif(user_id, 0) AS INT) AS nba_player_id, nullif({_SQL_V}, 0) AS nba_player2_id,
           CAST(NULL AS INT) AS nba_player3_id, nullif({_SQL_K}, 0) AS nba_team_id,
           CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE {_SQL_V} END AS score_home,
           CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN NULL ELSE {_SQL_K} END AS score_away,
           CAST(NULL AS DOUBLE) AS shot_x, CAST(NULL AS DOUBLE) AS shot_y, CAST(NULL AS INT) AS shot_distance,
           CAST(NULL AS BOOLEAN) AS shot_made
    FROM events WHERE ts < TIMESTAMP '{until}'
    QUALIFY row_number() OVER (PARTITION BY user_id, day(ts) * 24 + hour(ts) ORDER BY ts DESC, event_id DESC) = 1"""
_SQL_SEQUENCE = "CASE WHEN event_type = 'click' THEN day(ts) * 24 ELSE day(ts) * 24 + hour(ts) END"


def sql_new_events(since=_CUT):
    return f"""
    SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS nba_game_id, {_SQL_SEQUENCE} AS sequence,
           CAST(hour(ts) // 6 + 1 AS SMALLINT) AS period, 'PT08M15.00S' AS clock,
           CASE WHEN event_type IN ('error', 'signup') THEN 'Unknown' ELSE event_type END AS event_type,
           nullif(event_type, 'view') AS sub_type, props AS description,
           CAST(nullif(user_id, 0) AS INT) AS nba_player_id,
           CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN nullif({_SQL_K}, 0)
                ELSE nullif({_SQL_V}, 0) END AS nba_player2_id,
           CASE WHEN event_type = 'error' THEN NULL ELSE nullif({_SQL_K}, 0) END AS nba_player3_id,
           nullif({_SQL_K}, 0) AS nba_team_id,
           {_int('value')} AS score_home, {_int('value / 2')} AS score_away,
           CAST({_SQL_V} AS DOUBLE) / 4 AS shot_x, CAST(NULL AS DOUBLE) AS shot_y, {_SQL_V} AS shot_distance,
           CASE event_type WHEN 'click' THEN TRUE WHEN 'view' THEN FALSE END AS shot_made
    FROM events WHERE ts >= TIMESTAMP '{since}'
    QUALIFY row_number() OVER (PARTITION BY user_id, {_SQL_SEQUENCE} ORDER BY ts DESC, event_id DESC) = 1"""


def _events_for_compare(rows):
    return rows.withColumns({name: F.col(name).cast("double") for name in ("shot_x", "shot_y")})


@query("q_clean_old_events", sql_old_events())
def q_cleanold_events(spark, sf_dir):
    return _events_for_compare(clean.clean_old_events(old_events(spark, sf_dir)))


@query("q_clean_new_events", sql_new_events())
def q_cleannew_events(spark, sf_dir):
    return _events_for_compare(clean.clean_new_events(new_events(spark, sf_dir)))


@query("q_clean_events", f"SELECT * FROM ({sql_old_events()}) UNION ALL SELECT * FROM ({sql_new_events()})")
def q_clean_events(spark, sf_dir):
    """Both logs in one contract."""
    old, new = clean.clean_old_events(old_events(spark, sf_dir)), clean.clean_new_events(new_events(spark, sf_dir))
    return _events_for_compare(old.unionByName(new))
