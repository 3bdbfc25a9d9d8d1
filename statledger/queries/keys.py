"""De-duplication, key filters, lookups and foreign keys."""

from pyspark.sql import functions as F

from statledger.operators.dedupe import ORDINAL, keep_last
from statledger.operators.filters import distinct_opponents, fill_from_lookup, new_keys, with_valid_keys
from statledger.operators.resolve import UNRESOLVED, Reference, with_references
from statledger.plans.clean import team_name_lookup
from statledger.queries.registry import query
from statledger.queries.tables import (
    SQL_LAST_LINES,
    SQL_RAW_GAMES,
    SQL_TEAMS,
    line_order,
    load,
    raw_games,
    teams,
)


@query("q_dedupe_last", SQL_LAST_LINES)
def q_dedupe_last(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    return keep_last(rows.select("*", line_order()), ["l_orderkey", "l_linenumber"]).select(rows.columns)


@query("q_dedupe_null_keys", """
    SELECT k, max(event_id) AS event_id, arg_max(value, event_id) AS value
    FROM (SELECT nullif(user_id, 3) AS k, event_id, value FROM events) GROUP BY k""")
def q_dedupe_null_keys(spark, sf_dir):
    """NULL keys are one key; the last row of each key by event id."""
    rows = load(spark, sf_dir, "events").select(
        F.nullif(F.col("user_id"), F.lit(3)).alias("k"), "event_id", "value",
        F.col("event_id").alias(ORDINAL),
    )
    return keep_last(rows, ["k"])


@query("q_semi_valid_keys", f"""
    WITH teams AS ({SQL_TEAMS}), raw AS ({SQL_RAW_GAMES})
    SELECT game_id, edition, team_id_home, team_id_away FROM raw
    WHERE team_id_home IN (SELECT nba_team_id FROM teams)
      AND team_id_away IN (SELECT nba_team_id FROM teams) AND team_id_home <> team_id_away""")
def q_semi_valid_keys(spark, sf_dir):
    """Games between two different valid teams."""
    rows = distinct_opponents(
        raw_games(spark, sf_dir), "team_id_home", "team_id_away", teams(spark, sf_dir), "nba_team_id"
    )
    return rows.select("game_id", F.col(f"{ORDINAL}.edition").alias("edition"), "team_id_home", "team_id_away")


@query("q_valid_customers", f"""
    SELECT c_custkey, c_name, c_nationkey FROM customer
    WHERE c_nationkey IN (SELECT nba_team_id FROM ({SQL_TEAMS}))""")
def q_valid_customers(spark, sf_dir):
    rows = with_valid_keys(
        load(spark, sf_dir, "customer"), ["c_nationkey"], teams(spark, sf_dir), "nba_team_id"
    )
    return rows.select("c_custkey", "c_name", "c_nationkey")


@query("q_new_keys", """
    SELECT DISTINCT o_orderkey AS game_id FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def q_new_keys(spark, sf_dir):
    """Orders without line items: keys staged but not yet present."""
    staged = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"))
    present = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"))
    return new_keys(staged, present, "game_id")


@query("q_lookup_fill", f"""
    WITH names AS (
      SELECT p_brand, p_type, nullif(p_size, 1) AS team_id FROM part
      QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) = 1),
    lines AS (
      SELECT l.*, p_brand, p_type, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS given
      FROM lineitem l JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
           CAST(coalesce(given, team_id) AS BIGINT) AS team_id
    FROM lines LEFT JOIN names
      ON given IS NULL AND lines.p_brand = names.p_brand AND lines.p_type = names.p_type
         AND names.team_id IS NOT NULL""")
def q_lookup_fill(spark, sf_dir):
    """Blank team ids filled by (brand, type); the last row of a name decides, and one
    without an id removes the name."""
    part = load(spark, sf_dir, "part")
    histories = part.select(
        F.col("p_brand").alias("teamCity"), F.col("p_type").alias("teamName"),
        F.nullif(F.col("p_size"), F.lit(1)).cast("bigint").alias("teamId"),
        F.col("p_partkey").alias(ORDINAL),
    )
    rows = load(spark, sf_dir, "lineitem").join(
        part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey"
    ).withColumn("team_id", F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")))
    filled = fill_from_lookup(
        rows, "team_id", {"p_brand": "city", "p_type": "name"}, team_name_lookup(histories), "team_id"
    )
    return filled.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "team_id"
    )


def _resolved(rows, references, row=None):
    """The rows that a load would insert."""
    checked = with_references(rows, references, row)
    return checked.where(F.size(UNRESOLVED) == 0).drop(UNRESOLVED)


@query("q_resolve_inner", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
           o_orderstatus AS game_status, c.n_name AS home_name, s.n_name AS away_name
    FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey
    JOIN part ON p_partkey = l_partkey AND p_size > 5
    JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
    JOIN customer ON c_custkey = o_custkey
    JOIN nation c ON c.n_nationkey = c_nationkey AND c.n_regionkey <= 2
    JOIN nation s ON s.n_nationkey = s_nationkey AND s.n_regionkey <= 2""")
def q_resolve_inner(spark, sf_dir):
    """Lines with all required keys; the nation dimension is used in two roles."""
    nations = load(spark, sf_dir, "nation").where(F.col("n_regionkey") <= 2)
    lines = _resolved(load(spark, sf_dir, "lineitem"), [
        Reference("l_partkey", load(spark, sf_dir, "part").where(F.col("p_size") > 5), "p_partkey"),
        Reference(
            "l_suppkey", load(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0), "s_suppkey",
            carry={"s_nationkey": "away"},
        ),
        Reference(
            "l_orderkey", load(spark, sf_dir, "orders"), "o_orderkey",
            carry={"o_orderstatus": "game_status", "o_custkey": "custkey"},
        ),
    ])
    rows = _resolved(_resolved(lines, [
        Reference("custkey", load(spark, sf_dir, "customer"), "c_custkey", carry={"c_nationkey": "home"}),
    ]), [
        Reference("home", nations, "n_nationkey", carry={"n_name": "home_name"}),
        Reference("away", nations, "n_nationkey", carry={"n_name": "away_name"}),
    ])
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "game_status", "home_name", "away_name",
    )


@query("q_resolve_left", """
    SELECT e.event_id, g.c_custkey AS game_id, p1.s_suppkey AS player_id, p2.s_suppkey AS player2_id,
           p3.s_suppkey AS player3_id, t.n_nationkey AS team_id
    FROM (SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
                 CAST(floor(value) AS BIGINT) AS v FROM events) e
    JOIN customer g ON g.c_custkey = e.user_id AND g.c_acctbal > 1000
    LEFT JOIN supplier p1 ON p1.s_suppkey = e.k
    LEFT JOIN supplier p2 ON p2.s_suppkey = nullif(e.v, 0)
    LEFT JOIN supplier p3 ON p3.s_suppkey = e.user_id
    LEFT JOIN nation t ON t.n_nationkey = e.k""")
def q_resolve_left(spark, sf_dir):
    """Events of known games; player slots and team may be unknown and become NULL."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("game_id"), k.alias("player_id"),
        F.nullif(F.floor("value"), F.lit(0).cast("bigint")).alias("player2_id"),
        F.col("user_id").alias("player3_id"), k.cast("int").alias("team_id"),
    )
    players = load(spark, sf_dir, "supplier")
    return _resolved(rows, [
        Reference("game_id", load(spark, sf_dir, "customer").where(F.col("c_acctbal") > 1000), "c_custkey"),
        *[
            Reference(slot, players, "s_suppkey", required=False)
            for slot in ("player_id", "player2_id", "player3_id")
        ],
        Reference("team_id", load(spark, sf_dir, "nation"), "n_nationkey", required=False),
    ], "event_id")
