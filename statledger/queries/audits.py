"""Season spans, coverage, fill rates and the sync window."""

from pyspark.sql import functions as F

from statledger.operators.audit import (
    coverage,
    coverage_gaps,
    fill_rates,
    high_water_mark,
    season_spans,
)
from statledger.queries.registry import query
from statledger.queries.tables import SQL_GAMES, day, games, load


@query("q_season_spans", f"""
    SELECT season_id AS season_label, min(game_date) AS start_date, max(game_date) AS end_date
    FROM ({SQL_GAMES}) GROUP BY season_id""")
def q_season_spans(spark, sf_dir):
    return season_spans(games(spark, sf_dir).withColumnRenamed("season_id", "season_label"))


_SQL_COVERAGE = f"""
    SELECT season_id, count(*) AS n_games, count(l_orderkey) AS n_covered,
           CAST((CAST(count(l_orderkey) AS HUGEINT) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS coverage
    FROM ({SQL_GAMES}) LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = nba_game_id
    GROUP BY season_id"""


def _coverage(spark, sf_dir):
    audit = coverage(
        games(spark, sf_dir), "nba_game_id", "season_id", load(spark, sf_dir, "lineitem"), "l_orderkey"
    )
    return audit.withColumn("coverage", F.col("coverage").cast("double"))


@query("q_coverage_audit", _SQL_COVERAGE)
def q_coverage_audit(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query("q_coverage_gaps", f"SELECT * FROM ({_SQL_COVERAGE}) WHERE coverage < 0.985")
def q_coverage_gaps(spark, sf_dir):
    return coverage_gaps(_coverage(spark, sf_dir), 0.985)


@query("q_fill_rate", """
    SELECT event_type, count(*) AS n_rows,
           CAST((CAST(count(big) AS HUGEINT) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS filled_big,
           CAST((CAST(count(user_id) AS HUGEINT) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS filled_user_id,
           min(ts) AS first_moment, max(ts) AS last_moment
    FROM (SELECT *, CASE WHEN value > 20 THEN value END AS big FROM events) GROUP BY event_type""")
def q_fill_rate(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn(
        "big", F.when(F.col("value") > 20, F.col("value"))
    )
    profile = fill_rates(rows, ["event_type"], ["big", "user_id"], "ts")
    return profile.withColumns({
        name: F.col(name).cast("double") for name in ("filled_big", "filled_user_id")
    })


@query("q_high_water_mark", """
    SELECT CAST(max(CAST(o_orderdate AS DATE)) + 1 AS DATE) AS since,
           (SELECT count(*) FROM lineitem WHERE CAST(l_shipdate AS DATE) >=
              (SELECT max(CAST(o_orderdate AS DATE)) + 1 FROM orders)) AS n_later_rows
    FROM orders""")
def q_high_water_mark(spark, sf_dir):
    """The mark of the games, and the box-score lines from that day on."""
    mark = high_water_mark(games(spark, sf_dir)).select("since")
    later = load(spark, sf_dir, "lineitem").where(day("l_shipdate") >= mark.scalar())
    return later.agg(F.count("*").alias("n_later_rows")).select(mark.scalar().alias("since"), "n_later_rows")
