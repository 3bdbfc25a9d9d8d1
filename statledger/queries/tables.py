"""The given tables in the roles of the warehouse's frames.

nation plays the teams, supplier or customer the players, orders the games,
lineitem the box-score lines and events the event log. Each frame comes as a
Spark function and as the SQL text of the same rows for the oracle.
"""

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statledger.functions import season_label_from_date
from statledger.operators.dedupe import ORDINAL


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def day(column: str) -> Column:
    return F.col(column).cast("date")


# Oracle text for the season label of a day.
def sql_season(day_sql: str) -> str:
    year = f"(year({day_sql}) - CASE WHEN month({day_sql}) >= 8 THEN 0 ELSE 1 END)"
    return f"({year} || '-' || right(CAST({year} + 1 AS VARCHAR), 2))"


def sql_start_year(day_sql: str) -> str:
    return f"(year({day_sql}) - CASE WHEN month({day_sql}) >= 8 THEN 0 ELSE 1 END)"


# ---- games -------------------------------------------------------------------

GAME_TYPES = {"O": "Regular Season", "F": "Playoffs", "P": "Pre Season"}
_CODES = {"O": "2", "F": "4", "P": "1"}


def case_of(column: Column, choices: dict) -> Column:
    result = F
    for value, output in choices.items():
        result = result.when(column == value, output)
    return result


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the games table."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("nba_game_id"),
        season_label_from_date(day("o_orderdate")).alias("season_id"),
        day("o_orderdate").alias("game_date"),
        case_of(F.col("o_orderstatus"), GAME_TYPES).alias("game_type"),
    )


SQL_GAMES = f"""
    SELECT o_orderkey AS nba_game_id, {sql_season("CAST(o_orderdate AS DATE)")} AS season_id,
           CAST(o_orderdate AS DATE) AS game_date,
           CASE o_orderstatus WHEN 'O' THEN 'Regular Season' WHEN 'F' THEN 'Playoffs'
                WHEN 'P' THEN 'Pre Season' END AS game_type
    FROM orders"""


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season dimension, derived from the games."""
    return games(spark, sf_dir).select(F.col("season_id").alias("season_label")).distinct()


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Franchises: the nations of three of the five regions."""
    rows = load(spark, sf_dir, "nation").where(F.col("n_regionkey") <= 2)
    return rows.select(F.col("n_nationkey").alias("nba_team_id"), F.col("n_name").alias("name"))


SQL_TEAMS = "SELECT n_nationkey AS nba_team_id, n_name AS name FROM nation WHERE n_regionkey <= 2"


def raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide games export: every order, then corrected rows of the P orders."""
    orders = load(spark, sf_dir, "orders").join(
        load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    editions = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    rows = orders.withColumn("edition", F.explode(editions))
    date = day("o_orderdate")
    start = F.year(date) - F.when(F.month(date) >= 8, 0).otherwise(1)
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("game_id"),
        F.concat(case_of(F.col("o_orderstatus"), _CODES), start.cast("string")).alias("season_id"),
        date.cast("string").alias("game_date"),
        case_of(F.col("o_orderstatus"), GAME_TYPES).alias("season_type"),
        F.col("c_nationkey").alias("team_id_home"),
        (priority * 4).alias("team_id_away"),
        (F.floor(F.col("o_totalprice") / 1000) * 0.5 + F.col("edition") - 1).cast("double").alias("pts_home"),
        (F.floor(F.col("o_totalprice") / 2000) * 0.5).cast("double").alias("pts_away"),
        F.month(date).cast("double").alias("reb_home"),
        F.dayofmonth(date).cast("double").alias("reb_away"),
        (F.col("c_nationkey") + F.lit(0.5)).cast("double").alias("ast_home"),
        (priority + F.lit(0.5)).cast("double").alias("ast_away"),
        F.when(F.col("o_orderstatus") != "P", F.dayofmonth(date) / 2).alias("tov_home"),
        F.when(F.col("o_orderstatus") != "P", F.month(date) / 2).alias("tov_away"),
        F.struct("edition", "o_orderkey").alias(ORDINAL),
    )


_D = "CAST(o_orderdate AS DATE)"
SQL_RAW_GAMES = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS game_id, edition,
           CASE o_orderstatus WHEN 'O' THEN '2' WHEN 'F' THEN '4' WHEN 'P' THEN '1' END
             || {sql_start_year(_D)} AS season_id,
           {_D} AS game_date,
           CASE o_orderstatus WHEN 'O' THEN 'Regular Season' WHEN 'F' THEN 'Playoffs'
                WHEN 'P' THEN 'Pre Season' END AS season_type,
           c_nationkey AS team_id_home, CAST(left(o_orderpriority, 1) AS INT) * 4 AS team_id_away,
           CAST(floor(o_totalprice / 1000) * 0.5 + edition - 1 AS DOUBLE) AS pts_home,
           CAST(floor(o_totalprice / 2000) * 0.5 AS DOUBLE) AS pts_away,
           CAST(month({_D}) AS DOUBLE) AS reb_home, CAST(day({_D}) AS DOUBLE) AS reb_away,
           CAST(c_nationkey + 0.5 AS DOUBLE) AS ast_home,
           CAST(CAST(left(o_orderpriority, 1) AS INT) + 0.5 AS DOUBLE) AS ast_away,
           CASE WHEN o_orderstatus <> 'P' THEN day({_D}) / 2.0 END AS tov_home,
           CASE WHEN o_orderstatus <> 'P' THEN month({_D}) / 2.0 END AS tov_away
    FROM orders JOIN customer ON o_custkey = c_custkey,
         (SELECT unnest([1, 2]) AS edition)
    WHERE edition = 1 OR o_orderstatus = 'P'"""

# ---- box-score lines ---------------------------------------------------------

LINE_ORDER = [
    "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
SQL_LINE_ORDER_DESC = ", ".join(f"{name} DESC" for name in LINE_ORDER)
SQL_LAST_LINES = f"""
    SELECT * FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {SQL_LINE_ORDER_DESC}) = 1"""


def line_order() -> Column:
    return F.struct(*LINE_ORDER).alias(ORDINAL)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the box-score table: game = order, player = supplier.

    Some assists are NULL, and nobody has attempts of the second kind of shot.
    """
    quantity = F.col("l_quantity").cast("int")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_suppkey").alias("player_id"),
        (F.col("l_extendedprice").cast("decimal(12,2)") / 2000).cast("decimal(4,1)").alias("minutes"),
        quantity.alias("points"),
        F.col("l_linenumber").alias("rebounds"),
        F.nullif(quantity, F.lit(7)).alias("assists"),
        F.round(F.col("l_tax") * 100).cast("int").alias("steals"),
        F.round(F.col("l_discount") * 100).cast("int").alias("blocks"),
        F.month(day("l_shipdate")).alias("turnovers"),
        F.least(quantity, F.lit(20)).alias("fg_made"),
        quantity.alias("fg_attempted"),
        F.lit(0).alias("fg3_made"),
        F.lit(0).alias("fg3_attempted"),
        F.col("l_linenumber").alias("ft_made"),
        (F.col("l_linenumber") + quantity).alias("ft_attempted"),
    )


SQL_LINES = """
    SELECT l_orderkey AS game_id, l_suppkey AS player_id,
           (CAST(round(l_extendedprice * 100) AS BIGINT) + 10000) // 20000 AS minute_tenths,
           CAST(l_quantity AS INT) AS points, l_linenumber AS rebounds,
           nullif(CAST(l_quantity AS INT), 7) AS assists,
           CAST(round(l_tax * 100) AS INT) AS steals, CAST(round(l_discount * 100) AS INT) AS blocks,
           month(CAST(l_shipdate AS DATE)) AS turnovers,
           least(CAST(l_quantity AS INT), 20) AS fg_made, CAST(l_quantity AS INT) AS fg_attempted,
           0 AS fg3_made, 0 AS fg3_attempted, l_linenumber AS ft_made,
           l_linenumber + CAST(l_quantity AS INT) AS ft_attempted
    FROM lineitem"""


def sql_exact_average(column: str) -> str:
    """Average of whole numbers with one decimal, ties up, in exact arithmetic."""
    return (
        f"CAST((CAST(sum({column}) AS HUGEINT) * 20 + count({column})) // (2 * count({column})) AS DOUBLE) / 10"
    )
