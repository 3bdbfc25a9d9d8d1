"""Operators on small frames, compared with plain Python where the result is not obvious."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from statledger.operators.audit import coverage, coverage_gaps, fill_rates, season_spans
from statledger.operators.dedupe import ORDINAL, keep_last
from statledger.operators.filters import distinct_opponents, fill_from_lookup, new_keys
from statledger.operators.merge import classify, load_report, widen_ranges
from statledger.operators.quality import (
    broken_rule, check_violations, duplicate_keys, enforce, null_counts, orphans,
)
from statledger.operators.reshape import pair_sides, sides_to_rows
from statledger.operators.resolve import UNRESOLVED, Reference, with_references
from statledger.operators.windows import rolling_average


def tuples(frame):
    return sorted([tuple(r) for r in frame.collect()], key=lambda t: [(v is not None, v) for v in t])


def test_keep_last(spark):
    rows = spark.createDataFrame(
        [(1, "first", 0), (2, "only", 1), (1, "second", 2)], f"k int, v string, {ORDINAL} int"
    )
    assert tuples(keep_last(rows, ["k"])) == [(1, "second"), (2, "only")]


def test_keep_last_null_keys_and_null_values(spark):
    rows = spark.createDataFrame(
        [(None, "a", 0), (None, None, 1), (3, "c", 2)], f"k int, v string, {ORDINAL} int"
    )
    assert tuples(keep_last(rows, ["k"])) == [(None, None), (3, "c")]


def test_keep_last_prefers_usable_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0), (1, None, 1), (2, None, 0), (3, "x", 0), (3, "y", 1)], f"k int, v string, {ORDINAL} int"
    )
    assert tuples(keep_last(rows, ["k"], prefer="v")) == [(1, "a"), (2, None), (3, "y")]


def test_keep_last_reduces_copies_before_the_shuffle(spark):
    """A key with very many copies must not gather in one task."""
    rows = spark.range(1000).selectExpr("id % 2 AS k", "'a' AS t", f"id AS {ORDINAL}")
    plan = keep_last(rows, ["k", "t"])._jdf.queryExecution().executedPlan().toString()
    below_exchange = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below_exchange and "row_number(), 1, Partial" in below_exchange


def test_keep_last_key_only(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1)], f"k int, {ORDINAL} int")
    assert tuples(keep_last(rows, ["k"])) == [(1,)]


def test_distinct_opponents(spark):
    teams = spark.createDataFrame([(1,), (2,)], "id int")
    games = spark.createDataFrame([(1, 2), (1, 1), (1, 9), (None, 2)], "h int, a int")
    assert tuples(distinct_opponents(games, "h", "a", teams, "id")) == [(1, 2)]


def test_new_keys_are_sorted(spark):
    staged = spark.createDataFrame([("c",), ("a",), ("b",), ("c",)], "k string")
    known = spark.createDataFrame([("b",)], "k string")
    assert [r[0] for r in new_keys(staged, known, "k").collect()] == ["a", "c"]


def test_fill_from_lookup(spark):
    rows = spark.createDataFrame(
        [(1, None, "NY", "K"), (2, 7, "NY", "K"), (3, None, "LA", "L"), (4, None, None, "K")],
        "i int, team bigint, city string, name string",
    )
    lookup = spark.createDataFrame([("NY", "K", 5)], "c string, n string, id bigint")
    filled = fill_from_lookup(rows, "team", {"city": "c", "name": "n"}, lookup, "id")
    assert tuples(filled.select("i", "team")) == [(1, 5), (2, 7), (3, None), (4, None)]


@pytest.fixture()
def dims(spark):
    games = spark.createDataFrame([("g1", "s1"), ("g2", "s2")], "id string, season string")
    players = spark.createDataFrame([(1,), (2,)], "id int")
    return games, players


def test_references(spark, dims):
    games, players = dims
    rows = spark.createDataFrame(
        [("g1", 1, 2), ("g2", 1, 9), ("g9", 9, 1), ("g1", None, None)], "g string, p int, q int"
    )
    references = [
        Reference("g", games, "id", carry={"season": "season_label"}),
        Reference("p", players, "id"),
        Reference("q", players, "id", required=False),
    ]
    everything = tuples(with_references(rows, references))
    assert everything == [
        ("g1", None, None, "s1", ["p"]), ("g1", 1, 2, "s1", []),
        ("g2", 1, None, "s2", []), ("g9", 9, 1, None, ["g", "p"]),
    ]


def test_merge_laws(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")

    def merged(existing, staged):
        new = classify(with_references(staged, []), existing, ["k"]).where("outcome = 'inserted'")
        return existing.unionByName(new.select(existing.columns))

    once = merged(a, b)
    assert tuples(once) == [(1, "a"), (2, "a"), (3, "b")]
    assert tuples(merged(once, b)) == tuples(once)


def test_many_slots_of_one_dimension_are_one_join(spark, dims, no_broadcast):
    games, players = dims
    rows = spark.createDataFrame(
        [(0, "g1", 1, 2, 1), (1, "g1", None, 9, 2), (2, "g9", None, None, None), (3, None, 1, 1, 1), (4, "g2", 9, 8, 7)],
        "row long, g string, a int, b int, c int")
    references = [Reference("g", games, "id", carry={"season": "season_label"})] + [
        Reference(slot, players, "id", required=False) for slot in "abc"]
    found = with_references(rows, references, "row")
    assert tuples(found) == [
        (0, "g1", 1, 2, 1, "s1", []), (1, "g1", None, None, 2, "s1", []), (2, "g9", None, None, None, None, ["g"]),
        (3, None, 1, 1, 1, None, ["g"]), (4, "g2", None, None, None, "s2", [])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1
    needed = with_references(rows, [Reference(slot, players, "id") for slot in "ab"], "row")
    assert [r["_unresolved"] for r in needed.orderBy("row").collect()] == [[], ["a", "b"], ["a", "b"], [], ["a", "b"]]


def test_widen_is_commutative_and_ignores_nulls(spark):
    day = datetime.date
    schema = "k string, s date, e date"
    a = spark.createDataFrame([("x", day(2000, 1, 1), day(2000, 2, 1)), ("y", None, None)], schema)
    b = spark.createDataFrame([("x", day(1999, 1, 1), day(2000, 1, 5)), ("y", day(2001, 1, 1), None)], schema)
    one = tuples(widen_ranges(a, b, "k", "s", "e"))
    assert one == tuples(widen_ranges(b, a, "k", "s", "e"))
    assert one == [("x", day(1999, 1, 1), day(2000, 2, 1)), ("y", day(2001, 1, 1), None)]


def test_classify_and_report(spark, dims):
    games, _ = dims
    rows = with_references(
        spark.createDataFrame([("g1", 1), ("g1", 1), ("g2", 2), ("g9", 1)], "g string, p int"),
        [Reference("g", games, "id")],
    )
    known = spark.createDataFrame([("g2", 2)], "g string, p int")
    outcome = classify(rows, known, ["g", "p"])
    assert tuples(outcome.select("g", "outcome")) == [
        ("g1", "inserted"), ("g1", "present"), ("g2", "present"), ("g9", "unresolved"),
    ]
    assert load_report(outcome).first().asDict() == {
        "staged": 4, "inserted": 1, "present": 2, "unresolved": 1,
    }
    assert UNRESOLVED in outcome.columns


def test_sides_to_rows_order(spark):
    wide = spark.createDataFrame([("g", 1, 10, 1, 20, 0)], f"g string, h int, hp int, a int, ap int, {ORDINAL} int")
    sides = [{"team": "h", "points": "hp"}, {"team": "a", "points": "ap"}]
    long = sides_to_rows(wide, ["g"], sides)
    assert tuples(long.select("team", "points")) == [(1, 10), (1, 20)]
    # The same team on both sides: the away line comes later and stays.
    assert tuples(keep_last(long, ["g", "team"])) == [("g", 1, 20)]


def test_pair_sides_equals_last_of_all_pairs(spark):
    rows = [("g1", False, 1), ("g1", False, 2), ("g1", True, 3), ("g2", False, 4), ("g3", True, 5), ("g1", True, 6)]
    frame = spark.createDataFrame(
        [(*row, i) for i, row in enumerate(rows)], f"g string, away boolean, t int, {ORDINAL} int"
    )
    paired = pair_sides(frame, "g", F.col("away"), {"home": "t"}, {"visitor": "t"})
    assert tuples(paired) == [("g1", 2, 6)]


def plain_rolling(rows, n):
    """{(player, game): average} by brute force."""
    result = {}
    for player in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == player), key=lambda r: (r[1], r[2]))
        for i, row in enumerate(mine):
            window = [r[3] for r in mine[max(0, i - n + 1): i + 1] if r[3] is not None]
            result[(row[0], row[2])] = sum(window) / len(window) if window else None
    return result


@pytest.mark.parametrize("n,ranges", [(1, 5), (2, 40), (3, 9), (7, 60), (30, 60), (30, None)])
def test_rolling_average_of_cut_groups(spark, n, ranges):
    """Ranges cut groups and crowded days, some are shorter than the window, and all values are as of uncut ones."""
    rng = random.Random(n)
    start = datetime.date(2020, 1, 1)
    rows = []
    for player, count, spread in ((1, 150, 900), (2, 60, 40), (3, 5, 300), (None, 25, 200), (4, 200, 1)):
        for game in range(count):
            rows.append((player, start + datetime.timedelta(days=rng.randrange(spread)), game, rng.choice([None, *range(50)])))
    frame = spark.createDataFrame(rows, "p int, d date, g int, v int")
    rolled = rolling_average(frame, ["p"], "d", "g", "v", n, "avg_v", ranges)
    assert rolled.columns == ["p", "d", "g", "v", "avg_v"]
    found = {(r.p, r.g): r.avg_v for r in rolled.collect()}
    expected = plain_rolling(rows, n)
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value) if value is not None else found[key] is None


def test_rolling_average_keeps_types_and_reads_the_input_once(spark):
    frame = spark.range(100).selectExpr("1 as p", "date'2020-01-01' as d", "id as g", "cast(id as decimal(5,1)) as v")
    rolled = rolling_average(frame, ["p"], "d", "g", "v", 3, "avg_v", 8)
    assert dict(rolled.dtypes)["avg_v"] == "decimal(9,5)"
    assert {r.g: float(r.avg_v) for r in rolled.collect()} == {k: sum(range(max(0, k - 2), k + 1)) / min(3, k + 1) for k in range(100)}
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert "Range (0" not in plan
    # The rows are shuffled once more, by range; the windows and the join with the carried rows take them as they lie.
    wide = plan[:plan.index("FileScan")]
    assert wide.count("Exchange hashpartitioning(_range") == 1


def test_quality_reports(spark):
    rows = spark.createDataFrame(
        [(1, 5, "a"), (1, -1, None), (None, None, "b"), (2, 7, "z")], "k int, points int, t string"
    )
    assert tuples(duplicate_keys(rows, ["k"])) == [(1, 2)]
    assert tuples(check_violations(rows, {"points_nonneg": "points >= 0"})) == [("points_nonneg", 1)]
    assert tuples(null_counts(rows, ["k", "t"])) == [("k", 1), ("t", 1)]
    parents = spark.createDataFrame([(1,)], "id int")
    assert tuples(orphans(rows, "k", parents, "id")) == [(2, 1)]


def test_enforce_stops_the_job(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "k int, points int")
    rule = broken_rule(["k"], {"points_nonneg": "points >= 0"}, "t")
    assert enforce(rows, rule).count() == 2
    assert tuples(enforce(rows, rule)) == [(1, 5), (2, None)]
    for bad in ([(1, -1)], [(None, 1)]):
        frame = spark.createDataFrame(bad, "k int, points int")
        with pytest.raises(Exception, match="t violates points_nonneg|t.k is NULL"):
            enforce(frame, rule).collect()
        with pytest.raises(Exception, match="t violates points_nonneg|t.k is NULL"):
            enforce(frame, rule).select(F.lit(1)).collect()
        assert len(enforce(frame, rule, where=F.lit(False)).collect()) == 1


def test_audits(spark):
    day = datetime.date
    games = spark.createDataFrame(
        [("a", "s1", day(2000, 1, 1)), ("b", "s1", day(2000, 3, 1)), ("c", "s2", day(2001, 1, 1)), ("d", None, day(2009, 1, 1))],
        "g string, season_label string, game_date date",
    )
    assert tuples(season_spans(games)) == [
        ("s1", day(2000, 1, 1), day(2000, 3, 1)), ("s2", day(2001, 1, 1), day(2001, 1, 1)),
    ]
    events = spark.createDataFrame([("a", None), ("a", 1), ("x", 1)], "g string, x int")
    audit = coverage(games.dropna(), "g", "season_label", events, "g")
    assert [(r.season_label, r.n_games, r.n_covered, float(r.coverage)) for r in audit.orderBy("season_label").collect()] == [
        ("s1", 2, 1, 0.5), ("s2", 1, 0, 0.0),
    ]
    assert [r.season_label for r in coverage_gaps(audit, 0.4).collect()] == ["s2"]
    profile = fill_rates(events, ["g"], ["x"], "x").orderBy("g").first()
    assert (profile.n_rows, float(profile.filled_x), profile.first_moment) == (2, 0.5, 1)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_that_match_nothing_are_spread(spark, no_broadcast):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 100 != 0, F.lit(7)).alias("team"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("city"),
        F.when(F.col("id") % 50 == 0, F.col("id")).alias("slot"))
    lookup = spark.createDataFrame([("c0", 9)], "city string, value int")
    filled = fill_from_lookup(rows, "team", {"city": "city"}, lookup, "value")
    slots = spark.range(0, 1000, 50).withColumnRenamed("id", "key")
    found = with_references(rows, [Reference("slot", slots, "key", required=False)])
    assert {r["team"]: r["count"] for r in filled.groupBy("team").count().collect()} == {7: 1980, 9: 20}
    assert found.where("slot is not null").count() == 20 and found.count() == 2000
    for result in (filled, found):
        join = result._jdf.queryExecution().optimizedPlan().toString()
        assert "xxhash64" in join.split("Join LeftOuter")[1].split("\n")[0]
