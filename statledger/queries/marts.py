"""Season aggregate, its default slice, derived metrics and rolling averages."""

from pyspark.sql import functions as F

from statledger.operators.windows import rolling_average
from statledger.plans.marts import player_season_stats, regular_season, with_derived_metrics
from statledger.queries.registry import query
from statledger.queries.tables import (
    SQL_GAMES,
    SQL_LINES,
    day,
    games,
    lines,
    load,
    seasons,
    sql_exact_average,
)

_AVERAGES = ["points", "rebounds", "assists", "steals", "blocks", "turnovers"]
_SQL_AVERAGES = ",\n           ".join(
    f"{sql_exact_average(name)} AS avg_{name}" for name in _AVERAGES
)
_SQL_SHOTS = ",\n           ".join(
    f"CAST(sum({s}_made) AS BIGINT) AS total_{s}_made, CAST(sum({s}_attempted) AS BIGINT) AS total_{s}_attempted, "
    f"CAST((CAST(sum({s}_made) AS HUGEINT) * 2000 + sum({s}_attempted)) // nullif(2 * sum({s}_attempted), 0) AS DOUBLE)"
    f" / 1000 AS {s}_pct"
    for s in ("fg", "fg3", "ft")
)
_SQL_SEASON_STATS = f"""
    WITH games AS ({SQL_GAMES}), lines AS ({SQL_LINES})
    SELECT player_id, s_name AS full_name, season_id, season_id AS season_label, game_type,
           count(*) AS games_played,
           CAST((CAST(sum(minute_tenths) AS HUGEINT) * 2 + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS avg_minutes,
           {_SQL_AVERAGES},
           {_SQL_SHOTS}
    FROM lines JOIN supplier ON s_suppkey = player_id JOIN games ON nba_game_id = game_id
    GROUP BY player_id, s_name, season_id, game_type"""


def _doubles(df):
    """Decimal results as doubles, for the comparison only."""
    return df.select(
        *[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes]
    )


def _season_stats(spark, sf_dir):
    players = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("nba_player_id"), F.col("s_name").alias("full_name")
    )
    return player_season_stats(
        lines(spark, sf_dir), players, games(spark, sf_dir), seasons(spark, sf_dir)
    )


@query("q_season_stats", _SQL_SEASON_STATS)
def q_season_stats(spark, sf_dir):
    return _doubles(_season_stats(spark, sf_dir))


@query("q_season_stats_slice", f"""
    SELECT * FROM ({_SQL_SEASON_STATS}) WHERE game_type = 'Regular Season' AND season_label = '1997-98'""")
def q_season_stats_slice(spark, sf_dir):
    return _doubles(regular_season(_season_stats(spark, sf_dir), "1997-98"))


@query("q_derived_metrics", f"""
    SELECT game_id, player_id, points, CAST(points + rebounds + assists AS BIGINT) AS pra,
           round(CAST(fg_made AS DOUBLE) / nullif(fg_attempted, 0), 4) AS fg_pct,
           CAST(NULL AS DOUBLE) AS fg3_pct,
           round(CAST(ft_made AS DOUBLE) / nullif(ft_attempted, 0), 4) AS ft_pct
    FROM ({SQL_LINES})""")
def q_derived_metrics(spark, sf_dir):
    rows = with_derived_metrics(lines(spark, sf_dir))
    return rows.select(
        "game_id", "player_id", "points", F.col("pra").cast("bigint").alias("pra"),
        *[F.round(F.col(f"{s}_pct").cast("double"), 4).alias(f"{s}_pct") for s in ("fg", "fg3", "ft")],
    )


@query("q_rolling_avg", """
    SELECT o_custkey, o_orderkey, o_orderdate_day, CAST(s AS DOUBLE) / 100 / n AS avg_last_5
    FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate_day,
                 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS s, count(*) OVER w AS n
          FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey
                       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def q_rolling_avg(spark, sf_dir):
    """Averages of each customer's last five orders; the ranges cut groups, which the carried rows make whole."""
    rows = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", day("o_orderdate").alias("o_orderdate_day"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    rolled = rolling_average(
        rows, ["o_custkey"], "o_orderdate_day", "o_orderkey", "cents", 5, "avg_cents", ranges=32
    )
    return rolled.select(
        "o_custkey", "o_orderkey", "o_orderdate_day",
        (F.col("avg_cents") / 100).alias("avg_last_5"),
    )


@query("q_rolling_hot_day", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(s AS DOUBLE) / 100 / n AS avg_last_7
    FROM (SELECT *, sum(cents) OVER w AS s, count(cents) OVER w AS n
          FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS cents FROM lineitem)
          WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""")
def q_rolling_hot_day(spark, sf_dir):
    """One group with all lines, all on one day."""
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.lit(1).alias("player"), F.lit(0).alias("day"),
        F.when(F.col("l_linenumber") != 3, F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
    ).withColumn("place", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rolled = rolling_average(rows, ["player"], "day", "place", "cents", 7, "avg_cents", ranges=32)
    return rolled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("avg_cents") / 100).alias("avg_last_7"))
