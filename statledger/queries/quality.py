"""Constraint reports."""

import re

from pyspark.sql import functions as F

from statledger.operators.quality import broken_rule, check_violations, duplicate_keys, enforce, null_counts, orphans
from statledger.queries.registry import query
from statledger.queries.tables import load
from statledger.session import new_path


@query("q_dq_unique", """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_dq_unique(spark, sf_dir):
    return duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q_dq_unique_single", """
    SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def q_dq_unique_single(spark, sf_dir):
    return duplicate_keys(load(spark, sf_dir, "orders"), ["o_custkey"])


@query("q_dq_check", """
    SELECT 'points_nonneg' AS check_name, count(*) FILTER (c_acctbal < 0) AS n_violations FROM customer
    UNION ALL
    SELECT 'minutes_nonneg', count(*) FILTER (nullif(c_nationkey, 3) - 2 < 0) FROM customer
    UNION ALL
    SELECT 'distinct_teams', count(*) FILTER (c_nationkey = c_custkey) FROM customer""")
def q_dq_check(spark, sf_dir):
    """Row checks; a NULL passes."""
    rows = load(spark, sf_dir, "customer").select(
        F.col("c_acctbal").alias("points"),
        (F.nullif(F.col("c_nationkey"), F.lit(3)) - 2).alias("minutes"),
        F.col("c_nationkey").alias("home_team_id"), F.col("c_custkey").alias("away_team_id"),
    )
    return check_violations(rows, {
        "points_nonneg": "points >= 0", "minutes_nonneg": "minutes >= 0",
        "distinct_teams": "home_team_id <> away_team_id",
    })


@query("q_dq_not_null", """
    SELECT 'event_id' AS column_name, count(*) FILTER (event_id IS NULL) AS n_nulls FROM events
    UNION ALL SELECT 'user_id', count(*) FILTER (nullif(user_id, 0) IS NULL) FROM events
    UNION ALL SELECT 'event_type', count(*) FILTER (nullif(event_type, 'error') IS NULL) FROM events""")
def q_dq_not_null(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(
        "event_id", F.nullif(F.col("user_id"), F.lit(0)).alias("user_id"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
    )
    return null_counts(rows, ["event_id", "user_id", "event_type"])


@query("q_dq_orphans", """
    SELECT l_suppkey, count(*) AS n_rows FROM lineitem
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    GROUP BY l_suppkey""")
def q_dq_orphans(spark, sf_dir):
    known = load(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0)
    return orphans(load(spark, sf_dir, "lineitem"), "l_suppkey", known, "s_suppkey")


@query("q_dq_gate", """
    WITH batches AS (
      SELECT o_orderstatus AS batch, CASE WHEN o_orderstatus <> 'F' OR o_custkey % 7 <> 0 THEN o_custkey END AS player,
             CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS price
      FROM orders),
    checked AS (
      SELECT batch, count(*) AS n, count(*) FILTER (player IS NULL) AS nulls, count(*) FILTER (price < 0) AS negative
      FROM batches GROUP BY batch)
    SELECT batch, CASE WHEN nulls > 0 THEN 'orders.player is NULL' WHEN negative > 0 THEN 'orders violates price_nonneg' END AS stopped_by,
           CASE WHEN nulls + negative = 0 THEN n ELSE 0 END AS n_loaded
    FROM checked""")
def q_dq_gate(spark, sf_dir):
    """The fail-fast gate over three batches: one without violations, one with missing keys, one with bad values.

    A batch is written as a load writes it; of one that the gate stops nothing is to be read.
    """
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    rows = load(spark, sf_dir, "orders").select(
        status.alias("batch"), F.when((status != "F") | (F.col("o_custkey") % 7 != 0), F.col("o_custkey")).alias("player"),
        F.when((status == "P") & (F.col("o_orderkey") % 5 == 0), -price).otherwise(price).alias("price"),
    )
    rule = broken_rule(["player"], {"price_nonneg": "price >= 0"}, "orders")
    results = []
    for batch in [r["batch"] for r in rows.select("batch").distinct().collect()]:
        path = new_path(spark, "gate")
        message = None
        try:
            enforce(rows.where(F.col("batch") == batch), rule).write.parquet(path)
        except Exception as error:
            message = re.search(r"orders(\.\w+ is NULL| violates \w+)", str(error)).group()
        loaded = spark.read.schema(rows.schema).parquet(path).count()
        results.append((batch, message, loaded))
    return spark.createDataFrame(results, "batch string, stopped_by string, n_loaded bigint")
