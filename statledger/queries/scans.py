"""Projection scans, range scans, type contracts and unions of sources."""

from pyspark.sql import functions as F

from statledger.operators.reshape import add_nulls
from statledger.plans.clean import clean_teams
from statledger.operators.dedupe import ORDINAL
from statledger.queries.registry import query
from statledger.queries.tables import load
from statledger.sources.contracts import conform
from statledger.sources.exports import typed_cells, within_range


@query("q_scan_project", """
    SELECT s_suppkey::INT AS nba_team_id, left(s_name, 4) AS abbreviation, n_name AS city,
           s_name AS name, CAST(NULL AS VARCHAR) AS conference, CAST(NULL AS VARCHAR) AS division
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def q_scan_project(spark, sf_dir):
    """The team job: rename, select, constant NULL columns, keep the last row."""
    raw = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")
    ).select(
        F.col("s_suppkey").alias("id"), F.left(F.col("s_name"), F.lit(4)).alias("abbreviation"),
        F.col("n_name").alias("city"), F.col("s_name").alias("nickname"),
        F.col("s_suppkey").alias(ORDINAL),
    )
    return clean_teams(raw)


@query("q_parquet_range_scan", """
    SELECT event_id, ts, user_id, event_type FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def q_parquet_range_scan(spark, sf_dir):
    """Half-open time range, pushed to the Parquet row groups."""
    since, until = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-01-20"))
    rows = within_range(load(spark, sf_dir, "events"), "ts", since, until)
    return rows.select("event_id", "ts", "user_id", "event_type")


_SQL_TOKEN = """CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'NA' WHEN 'MACHINERY' THEN ''
                WHEN 'FURNITURE' THEN ' n/a' ELSE c_mktsegment END"""


@query("q_conform_types", f"""
    SELECT CAST(c_custkey AS INT) AS id,
           CASE WHEN c_nationkey IN (3, 4, 5) THEN NULL
                ELSE CAST(round_even(c_custkey / 2.0, 0) AS INT) END AS half,
           CASE WHEN ({_SQL_TOKEN}) IN ('NA', '') THEN NULL ELSE ({_SQL_TOKEN}) END AS segment,
           CASE WHEN c_nationkey IN (3, 4, 5) THEN NULL ELSE CAST(c_custkey AS DOUBLE) / 2 END AS score,
           CAST(NULL AS DATE) AS absent
    FROM customer""")
def q_conform_types(spark, sf_dir):
    """Text cells to types: missing tokens, bad numbers, ties to even, absent columns."""
    key = F.col("c_custkey")
    half = F.concat((key.cast("bigint") / 2).cast("decimal(20,1)").cast("string"))
    odd_text = F.create_map(
        F.lit(3), F.lit("n/a"), F.lit(4), F.lit("1d"), F.lit(5), F.lit("twelve")
    )[F.col("c_nationkey")]
    cells = load(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        F.coalesce(odd_text, half).alias("half"),
        F.coalesce(
            F.create_map(
                F.lit("HOUSEHOLD"), F.lit("NA"), F.lit("MACHINERY"), F.lit(""),
                F.lit("FURNITURE"), F.lit(" n/a"),
            )[F.col("c_mktsegment")],
            F.col("c_mktsegment"),
        ).alias("segment"),
        F.coalesce(odd_text, half).alias("score"),
    )
    typed = typed_cells(cells, {"id": "int", "half": "int", "segment": "string", "score": "double"})
    return conform(typed, {
        "id": "int", "half": "int", "segment": "string", "score": "double", "absent": "date",
    })


@query("q_union_sources", """
    SELECT event_id, ts, event_type, CAST(NULL AS DOUBLE) AS value, 'old' AS era FROM events
    WHERE ts < TIMESTAMP '2024-01-15'
    UNION ALL
    SELECT event_id, ts, upper(event_type), value, 'new' FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def q_union_sources(spark, sf_dir):
    """Two eras cut at one day, in one set of columns."""
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    events = load(spark, sf_dir, "events")
    old = within_range(events, "ts", until=cut).select("event_id", "ts", "event_type")
    new = within_range(events, "ts", since=cut).select(
        "event_id", "ts", F.upper("event_type").alias("event_type"), "value", F.lit("new").alias("era")
    )
    old = add_nulls(old, {"value": "double"}).withColumn("era", F.lit("old"))
    return old.unionByName(new)
