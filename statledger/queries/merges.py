"""Insert-if-absent, widening upsert and the load report."""

from pyspark.sql import functions as F

from statledger.operators.audit import season_spans
from statledger.operators.merge import INSERTED, OUTCOME, classify, load_report, widen_ranges
from statledger.operators.resolve import UNRESOLVED, Reference, with_references
from statledger.queries.registry import query
from statledger.queries.tables import SQL_GAMES, games, load


def _absent(existing, staged, keys):
    """The staged rows that a load would insert."""
    outcome = classify(with_references(staged, []), existing, keys)
    return outcome.where(F.col(OUTCOME) == INSERTED).drop(OUTCOME, UNRESOLVED)


@query("q_insert_if_absent", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def q_insert_if_absent(spark, sf_dir):
    """Staged orders that are not yet known through a returned line."""
    existing = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    staged = load(spark, sf_dir, "orders").drop("o_orderpriority")
    return _absent(existing, staged, ["o_orderkey"])


@query("q_merge_first_wins", """
    SELECT o_orderkey AS game_id, 'orders' AS source, o_totalprice AS amount FROM orders
    WHERE o_orderstatus <> 'P'
    UNION ALL
    SELECT l_orderkey, 'lineitem', sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    GROUP BY l_orderkey""")
def q_merge_first_wins(spark, sf_dir):
    """Two loads of the same keys: what the first wrote stays, the second adds the rest."""
    first = load(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("game_id"), F.lit("orders").alias("source"),
        F.col("o_totalprice").alias("amount"),
    )
    second = (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("game_id"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
        .select("game_id", F.lit("lineitem").alias("source"), "amount")
    )
    return first.unionByName(_absent(first, second, ["game_id"]))


@query("q_widen_upsert", f"""
    SELECT season_label, min(start_date) AS start_date, max(end_date) AS end_date FROM (
      SELECT season_id AS season_label, min(game_date) AS start_date, max(game_date) AS end_date
      FROM ({SQL_GAMES}) WHERE game_type = 'Playoffs' GROUP BY season_id
      UNION ALL
      SELECT season_id, min(game_date), max(game_date)
      FROM ({SQL_GAMES}) WHERE game_type <> 'Playoffs' GROUP BY season_id)
    GROUP BY season_label""")
def q_widen_upsert(spark, sf_dir):
    rows = games(spark, sf_dir).withColumnRenamed("season_id", "season_label")
    playoffs = F.col("game_type") == "Playoffs"
    return widen_ranges(
        season_spans(rows.where(playoffs)), season_spans(rows.where(~playoffs)),
        "season_label", "start_date", "end_date",
    )


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_SQL_CLASSIFIED = """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice,
           CASE WHEN s_suppkey IS NULL OR p_partkey IS NULL THEN 'unresolved'
                WHEN o_orderkey IS NOT NULL OR row_number() OVER (
                  PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) > 1
                THEN 'present' ELSE 'inserted' END AS outcome,
           CASE WHEN s_suppkey IS NULL AND p_partkey IS NULL THEN 'l_partkey,l_suppkey'
                WHEN p_partkey IS NULL THEN 'l_partkey' WHEN s_suppkey IS NULL THEN 'l_suppkey'
                ELSE '' END AS reason
    FROM lineitem l
    LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5
    LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
    LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'"""


def _classified(spark, sf_dir):
    staged = with_references(load(spark, sf_dir, "lineitem"), [
        Reference("l_partkey", load(spark, sf_dir, "part").where(F.col("p_size") > 5), "p_partkey"),
        Reference("l_suppkey", load(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0), "s_suppkey"),
    ])
    loaded = load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = load(spark, sf_dir, "lineitem").join(loaded, "l_orderkey", "left_semi")
    return classify(staged, lines.select(*_LINE_KEY).distinct(), _LINE_KEY)


@query("q_load_outcome", _SQL_CLASSIFIED)
def q_load_outcome(spark, sf_dir):
    """Every staged line with its outcome and the keys it lacks."""
    return _classified(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "outcome", F.concat_ws(",", "_unresolved").alias("reason"),
    )


@query("q_load_report", f"""
    SELECT count(*) AS staged, count(*) FILTER (outcome = 'inserted') AS inserted,
           count(*) FILTER (outcome = 'present') AS present,
           count(*) FILTER (outcome = 'unresolved') AS unresolved
    FROM ({_SQL_CLASSIFIED})""")
def q_load_report(spark, sf_dir):
    return load_report(_classified(spark, sf_dir))
