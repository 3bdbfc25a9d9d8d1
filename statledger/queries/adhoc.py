"""Guarded ad-hoc SELECT queries. The row cap is the operator itself."""

from statledger.plans.adhoc import guarded_select, run_query
from statledger.queries.registry import query
from statledger.queries.tables import load

_TABLES = ("nation", "customer", "orders", "lineitem")


def _select(spark, sf_dir, sql, row_cap=200):
    return guarded_select(spark, sql, {
        name: lambda session, name=name: load(session, sf_dir, name) for name in _TABLES}, row_cap)


_TOP_ORDERS = """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"""


@query("q_adhoc_capped", _TOP_ORDERS + " LIMIT 200")
def q_adhoc_capped(spark, sf_dir):
    """No limit of its own: the cap applies."""
    return _select(spark, sf_dir, _TOP_ORDERS)


@query("q_adhoc_own_limit", _TOP_ORDERS + " LIMIT 50")
def q_adhoc_own_limit(spark, sf_dir):
    """A smaller limit stays in force."""
    return _select(spark, sf_dir, _TOP_ORDERS + " LIMIT 50")


@query("q_adhoc_cte", """
    WITH totals AS (
      SELECT c_nationkey, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)
    SELECT n_name, n_orders, n_customers FROM totals JOIN nation ON n_nationkey = c_nationkey
    WHERE n_orders > (SELECT avg(n_orders) FROM totals)""")
def q_adhoc_cte(spark, sf_dir):
    """A WITH query with a join and a scalar subquery."""
    return _select(spark, sf_dir, """
        WITH totals AS (
          SELECT c_nationkey, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
          FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)
        SELECT n_name, n_orders, n_customers FROM totals JOIN nation ON n_nationkey = c_nationkey
        WHERE n_orders > (SELECT avg(n_orders) FROM totals)""")


@query("q_adhoc_window", """
    SELECT o_custkey, o_orderkey, r FROM (
      SELECT o_custkey, o_orderkey,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
      FROM orders)
    WHERE r = 1 ORDER BY o_custkey LIMIT 100""")
def q_adhoc_window(spark, sf_dir):
    """A ranking window in a subquery, with the cap below the query's own limit."""
    return _select(spark, sf_dir, """
        SELECT o_custkey, o_orderkey, r FROM (
          SELECT o_custkey, o_orderkey,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
          FROM orders) ranked
        WHERE r = 1 ORDER BY o_custkey LIMIT 5000""", row_cap=100)


_STAR = """
    SELECT n_name, year(o_orderdate) AS year, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_players,
           sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned, max(upper(left(o_orderpriority, 3))) AS top
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE l_quantity BETWEEN 5 AND 45 AND coalesce(n_regionkey, 0) <> 3
    GROUP BY n_name, year(o_orderdate) HAVING count(*) > 10
    ORDER BY n_lines DESC, n_name, year LIMIT 60"""


@query("q_adhoc_star_join", _STAR)
def q_adhoc_star_join(spark, sf_dir):
    """A fact with three dimensions: listed functions, grouping, ordering and a limit of its own."""
    return _select(spark, sf_dir, _STAR)


@query("q_adhoc_truncated", """
    SELECT 'all' AS name, 200 AS n_rows, true AS truncated FROM orders HAVING count(*) > 200
    UNION ALL SELECT 'few', count(*), false FROM nation
    UNION ALL SELECT 'own limit', 200, false FROM orders HAVING count(*) >= 200
    UNION ALL SELECT 'refused', 0, NULL FROM nation WHERE n_nationkey = 0
    UNION ALL SELECT 'pairs', 0, NULL FROM nation WHERE n_nationkey = 0""")
def q_adhoc_truncated(spark, sf_dir):
    """What a caller is told: rows, and whether the cap has cut them; refused texts give none."""
    tables = {name: lambda session, name=name: load(session, sf_dir, name) for name in ("nation", "orders", "lineitem")}
    texts = {
        "all": "SELECT o_orderkey FROM orders", "few": "SELECT n_name FROM nation;",
        "own limit": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 200",
        "refused": "SELECT /*+ BROADCAST(o) */ count(*) FROM orders o JOIN nation ON n_nationkey = o_custkey",
        "pairs": "SELECT count(*) FROM lineitem a JOIN lineitem b ON a.l_orderkey < b.l_orderkey JOIN lineitem c ON c.l_tax > b.l_tax",
    }
    told = {name: run_query(spark, sql, tables, timeout_ms=60_000) for name, sql in texts.items()}
    rows = [(name, len(found.get("rows", [])), found.get("truncated")) for name, found in told.items()]
    return spark.createDataFrame(rows, "name string, n_rows long, truncated boolean")
