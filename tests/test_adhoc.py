"""Guarded ad-hoc queries."""

import threading

import pytest

from statledger.plans import adhoc


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "games": lambda session: session.range(1000).selectExpr(
            "id", "cast(id AS decimal(10,1)) AS score", "date'2025-10-21' AS game_date"
        )
    }


@pytest.mark.parametrize("sql,rows", [
    ("SELECT id FROM games", 200),
    ("SELECT id FROM games LIMIT 50", 50),
    ("SELECT id FROM games LIMIT 100000", 200),
    ("SELECT id FROM (SELECT id FROM games LIMIT 300) g", 200),
    ("WITH g AS (SELECT id FROM games WHERE id < 5) SELECT * FROM g", 5),
    ("(SELECT id FROM games WHERE id < 3)", 3),
    ("SELECT id % 7 AS m, count(*) AS n FROM games GROUP BY id % 7 HAVING count(*) > 142", 6),
    ("SELECT a.id FROM games a JOIN games b ON a.id = b.id + 999", 1),
    ("SELECT id FROM games WHERE id IN (SELECT id FROM games WHERE id > 997)", 2),
    ("SELECT id, avg(score) OVER (ORDER BY id ROWS 4 PRECEDING) AS r FROM games ORDER BY id DESC LIMIT 3", 3),
])
def test_allowed(spark, tables, sql, rows):
    result = adhoc.run_query(spark, sql, tables)
    assert len(result["rows"]) == rows
    assert sql in result["sql"] and result["sql"].endswith("LIMIT 201")


@pytest.mark.parametrize("sql", [
    "INSERT INTO games VALUES (1)", "DELETE FROM games", "DROP TABLE games", "CREATE TABLE t AS SELECT 1",
    "SELECT 1; SELECT 2", "WITH d AS (DELETE FROM games) SELECT 1", "garbage", "", "VALUES (1)", "TABLE games",
    "SELECT 1 UNION SELECT 2", "SELECT 1 UNION ALL SELECT 2", "SELECT 1 INTERSECT SELECT 1", "SET x = 1",
    "SHOW TABLES", "EXPLAIN SELECT 1", "CACHE TABLE games", "SELECT * FROM secrets",
    "SELECT (SELECT max(id) FROM secrets) AS m FROM games",
    "WITH g AS (SELECT * FROM secrets) SELECT * FROM g",
    "SELECT * FROM parquet.`/etc`", "SELECT * FROM default.games", "SELECT * FROM range(10)",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.System', 'exit', 1)",
    "SELECT id FROM games WHERE reflect('java.lang.Math', 'abs', 1) = 1",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM games", "SELECT * FROM IDENTIFIER('parquet.`/etc`')",
    "SELECT * FROM games |> WHERE id < 3",
    "SELECT /*+ BROADCAST(g) */ id FROM games g", "SELECT id FROM (SELECT /*+ REPARTITION(9) */ id FROM games) g",
    "SELECT /*+ MERGE(a) */ a.id FROM games a JOIN games b ON a.id = b.id",
    "SELECT input_file_name() FROM games", "SELECT current_user() FROM games", "SELECT version()", "SELECT uuid() FROM games",
    "SELECT explode(sequence(1, 1000000000)) FROM games", "SELECT repeat('x', 1000000000) FROM games",
    "SELECT aes_encrypt('a', 'b') FROM games", "SELECT current_catalog()", "SELECT java_method('java.lang.Math', 'abs', id) FROM games",
    "SELECT id FROM games WHERE id > (SELECT max(monotonically_increasing_id()) FROM games)",
    "SELECT 1) AS a, (SELECT 2", "SELECT 1 AS a) AS x WHERE a IN (SELECT 1",
])
def test_rejected(spark, tables, sql):
    with pytest.raises(adhoc.UnsafeQueryError):
        adhoc.vet(spark, sql, tables)
    assert "error" in adhoc.run_query(spark, sql, tables)


def test_values_are_json_safe(spark, tables):
    result = adhoc.run_query(spark, "SELECT score, game_date FROM games WHERE id = 7", tables)
    assert result["rows"] == [{"score": "7.0", "game_date": "2025-10-21"}]


def test_failing_query_returns_the_error(spark, tables):
    assert "UNRESOLVED_COLUMN" in adhoc.run_query(spark, "SELECT nope FROM games", tables)["error"]
    assert "DIVIDE_BY_ZERO" in adhoc.run_query(spark, "SELECT id / (id - id) AS x FROM games", tables)["error"]


def test_slow_query_is_stopped(spark):
    tables = {"numbers": lambda session: session.range(10**12)}
    result = adhoc.run_query(spark, "SELECT max(sqrt(id)) AS m FROM numbers", tables, timeout_ms=1500)
    assert "error" in result
    # Its tasks have stopped as well: the next query finds free cores.
    assert adhoc.run_query(spark, "SELECT 1 AS one", tables)["rows"] == [{"one": 1}]


def test_computed_function_names_are_refused(spark):
    for text in (
        "SELECT identifier('reflect')('java.lang.System', 'getProperty', 'user.home') FROM t",
        "SELECT identifier('x') FROM t",
    ):
        with pytest.raises(adhoc.UnsafeQueryError):
            adhoc.vet(spark, text, {"t": lambda session: session.range(3)})


def test_equal_column_names_keep_both_values(spark):
    tables = {"t": lambda session: session.sql("SELECT 1 AS id, 2 AS v")}
    out = adhoc.run_query(spark, "SELECT a.id, b.id, count(*), count(*) FROM t a JOIN t b ON a.id = b.id GROUP BY 1, 2", tables)
    assert out["rows"] == [{"id": 1, "id_2": 1, "count(1)": 1, "count(1)_2": 1}]


def test_a_comment_at_the_end_is_no_way_out(spark, tables):
    result = adhoc.run_query(spark, "SELECT id FROM games -- all of them", tables, row_cap=3)
    assert len(result["rows"]) == 3 and result["truncated"]


@pytest.mark.parametrize("sql,cap,truncated", [
    ("SELECT id FROM games", 999, True), ("SELECT id FROM games", 1000, False), ("SELECT id FROM games LIMIT 5", 5, False),
])
def test_a_cut_is_reported(spark, tables, sql, cap, truncated):
    assert adhoc.run_query(spark, sql, tables, row_cap=cap)["truncated"] is truncated


@pytest.mark.parametrize("sql", [
    "SELECT g, sum(id), avg(score), count(DISTINCT id) FROM (SELECT id % 3 AS g, * FROM games) x GROUP BY ROLLUP(g) ORDER BY g",
    "SELECT upper(concat('a', cast(id AS string))), year(game_date), date_add(game_date, 3), game_date - INTERVAL 1 DAY FROM games",
    "SELECT nvl(nullif(id, 3), 0), round(score / 3, 2), CASE WHEN id IS NULL THEN 1 END, id BETWEEN 1 AND 2, id IN (1, 2, 3) FROM games",
    "SELECT lag(id) OVER (ORDER BY id), dense_rank() OVER (PARTITION BY id % 2 ORDER BY score DESC) FROM games",
    "SELECT g.id FROM games g LEFT JOIN games h USING (id) WHERE NOT EXISTS (SELECT 1 FROM games i WHERE i.id = g.id + 1)",
    "SELECT * FROM games WHERE lower('X') LIKE '%x%' AND game_date > date'2020-01-01' ORDER BY game_date, id DESC OFFSET 3",
    "SELECT (SELECT max(id) FROM games), 'a' || 'b', -id, percentile_approx(id, 0.5) FROM games GROUP BY id",
    "SELECT max_by(id, score), count_if(id > 3), stddev(id), median(id) FROM games",
])
def test_plain_sql_is_allowed(spark, tables, sql):
    assert "rows" in adhoc.run_query(spark, sql, tables), adhoc.run_query(spark, sql, tables)


def test_queries_do_not_see_each_other(spark, tables):
    """Two callers with tables of one name, at once; the caller's own views are neither seen nor replaced."""
    spark.range(7).createOrReplaceTempView("games")
    spark.range(7).createOrReplaceTempView("mine")
    other = {"games": lambda session: session.range(5)}
    results = {}

    def ask(name, own):
        results[name] = [adhoc.run_query(spark, "SELECT count(*) AS n FROM games", own)["rows"][0]["n"] for _ in range(3)]

    threads = [threading.Thread(target=ask, args=args) for args in (("a", tables), ("b", other))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert results == {"a": [1000] * 3, "b": [5] * 3}
    assert "error" in adhoc.run_query(spark, "SELECT * FROM mine", tables)
    assert spark.table("games").count() == 7
    spark.sql("CREATE VIEW default.of_catalog AS SELECT 1 AS x")
    try:
        assert "error" in adhoc.run_query(spark, "SELECT * FROM of_catalog", tables)
        assert "error" in adhoc.run_query(spark, "SELECT * FROM default.of_catalog", tables)
    finally:
        spark.sql("DROP VIEW default.of_catalog")


def test_joins_of_all_with_all_are_refused(spark):
    tables = {"big": lambda session: session.range(10**7), "small": lambda session: session.range(10)}
    for sql in ("SELECT count(*) FROM big a JOIN big b ON a.id < b.id", "SELECT count(*) FROM big a, big b",
                "SELECT id FROM small WHERE id = (SELECT count(*) FROM big a CROSS JOIN big b)"):
        assert "too large" in adhoc.run_query(spark, sql, tables)["error"]
    assert adhoc.run_query(spark, "SELECT count(*) AS n FROM small a, small b WHERE a.id < b.id", tables)["rows"] == [{"n": 45}]
    assert "rows" in adhoc.run_query(spark, "SELECT count(*) FROM big a JOIN small b USING (id)", tables, timeout_ms=60_000)
