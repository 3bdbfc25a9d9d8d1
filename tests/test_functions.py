"""Value parsers on small inputs."""

import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from statledger import functions as fn
from statledger.operators.dedupe import keep_last
from statledger.sources.exports import read_csv, typed_cells
from statledger.sources.layouts import GAMES, Layout


def values(spark, kind, inputs, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_height(spark):
    heights = {"5-10": 70, "6-11": 83, "0-3": 3, "4-": 48, " 5 - 2 ": 62, "+7-1": 85, "5-14": 74, "70": None, "-8": None, "tall": None,
               "5'10": None, "5-x": None, "": None, None: None}
    assert values(spark, "string", list(heights), fn.parse_height) == list(heights.values())


def test_clock_minutes(spark):
    # Three seconds are half a tenth and go away from zero; fractions of seconds are exact too.
    clocks = {"18:06": "18.1", "18:03": "18.1", "18:02": "18.0", "18:02.999": "18.0", "-18:03": "-18.0", "-0:00": "0.0", "00:00": "0.0",
              "9.95": "10.0", "9.9499999999999": "9.9", "7": "7.0", "+7:30": "7.5", "\t12:57\n": "13.0", "59:59": "60.0", "1e1": "10.0",
              "4:5:6": None, ":30": None, "30:": None, "x": None, "PT1M": None, "": None, None: None}
    wanted = [None if v is None else Decimal(v) for v in clocks.values()]
    assert values(spark, "string", list(clocks), fn.parse_clock_minutes) == wanted


def test_feed_minutes(spark):
    texts = ["PT21M48.00S", "21:48", "PT8M3S", "PT", "PT30S", None, "", "-2:15", "PT1.2.3S", "DNP", "PT1H",
             "P1DT2H3M", "PT0.5H", "P", "P1", "P0:1:2:3", "1:2:3:4", "PT-1M", "P01:02:03:04"]
    assert values(spark, "string", texts, fn.parse_feed_minutes) == [
        Decimal("21.8"), Decimal("21.8"), Decimal("8.1"), Decimal("0.0"), Decimal("0.5"),
        None, None, None, None, None, Decimal("60.0"),
        Decimal("1563.0"), Decimal("30.0"), None, None, None, None, None, None,
    ]


def test_round_minutes_half_up_and_negative(spark):
    numbers = [27.283333333333331, 0.25, 0.35, -5.0, float("nan"), None, 12.549999999999999, 39.04999999999999, 0.049999999999999996]
    assert values(spark, "double", numbers, fn.round_minutes) == [
        Decimal("27.3"), Decimal("0.3"), Decimal("0.4"), None, None, None, Decimal("12.5"), Decimal("39.0"), Decimal("0.0"),
    ]


def test_nullable_int_half_even(spark):
    numbers = [2.5, 3.5, -0.5, float("nan"), float("inf"), None, 7.0]
    assert values(spark, "double", numbers, fn.nullable_int) == [2, 4, 0, None, None, None, 7]


def test_number_from_text(spark):
    texts = ["12", " 1e3 ", "12.0", "1d", "0x1p3", "abc", "", "NaN", None, ".5"]
    assert values(spark, "string", texts, fn.number_from_text) == [
        12.0, 1000.0, 12.0, None, None, None, None, None, None, 0.5,
    ]


def test_zero_as_null(spark):
    assert values(spark, "bigint", [0, 5, None], fn.zero_as_null) == [None, 5, None]


def test_missing(spark):
    assert values(spark, "double", [1.0, float("nan"), None], fn.is_missing) == [False, True, True]
    texts = ["NA", "", "null", "nan", "Nets", " NA"]
    assert values(spark, "string", texts, fn.drop_missing_tokens) == [None, None, None, None, "Nets", " NA"]


def test_pad_id(spark):
    padded = {"7": "0000000007", "0000000007": "0000000007", "": "0000000000", "998877665544": "998877665544", None: None}
    assert values(spark, "string", list(padded), fn.pad_id) == list(padded.values())


def test_dates(spark):
    texts = ["2031-03-08", "2031-03-08 19:30:00", None]
    day = datetime.date(2031, 3, 8)
    assert values(spark, "string", texts, fn.parse_date) == [day, day, None]
    others = ["3/8/2031", "03/08/2031 19:30", "2031/3/8", "20310308", "Mar 8, 2031", "8 March 2031", " 2031-03-08T01:02:03Z "]
    assert values(spark, "string", others, fn.parse_date) == [day] * len(others)
    assert values(spark, "string", ["13/1/2031", "31/31/31", ""], lambda c: fn.parse_date(c, strict=False)) == [None] * 3
    with pytest.raises(Exception, match="no date: garbage"):
        values(spark, "string", ["garbage"], fn.parse_date)
    lenient = values(spark, "string", ["garbage"], lambda c: fn.parse_date(c, strict=False))
    assert lenient == [None]


def test_season_labels(spark):
    assert values(spark, "string", ["22030", "41999", "1abc"], fn.season_label_from_code) == [
        "2030-31", "1999-00", None,
    ]
    types = values(spark, "string", ["12030", "22030", "32030", "42030", "52030", "92030"], fn.game_type_from_code)
    assert types == ["Pre Season", "Regular Season", "All-Star", "Playoffs", "Play-In Tournament", "Unknown (9)"]
    days = [datetime.date(1955, 12, 1), datetime.date(2020, 7, 31), datetime.date(2020, 8, 1)]
    assert values(spark, "date", days, fn.season_label_from_date) == ["1955-56", "2019-20", "2020-21"]


def test_event_values(spark):
    assert values(spark, "int", [1, 12, 18, 999, None], fn.code_label) == [
        "Made Shot", "Start of Period", "Instant Replay", "Unknown (999)", "Unknown",
    ]
    assert values(spark, "string", [None, " ", " 2pt\t", "\n"], fn.event_type_or_unknown) == [
        "Unknown", "Unknown", "2pt", "Unknown",
    ]
    assert values(spark, "string", ["Made", ": Missed", "", None], fn.shot_made) == [True, False, None, None]
    assert values(spark, "string", ["0 - 2", "7", None], lambda c: fn.score_part(c, 2)) == ["2", None, None]


def test_role_slot_chooses_before_the_zero_test(spark):
    rows = spark.createDataFrame(
        [("0", "5"), (None, "5"), ("7", "5"), (None, "0"), ("x", "5")], "a string, b string"
    )
    slots = [r[0] for r in rows.select(fn.role_slot(F.col("a"), F.col("b"))).collect()]
    assert slots == [None, 5, 7, None, None]


def test_full_name(spark):
    rows = spark.createDataFrame([("Ida", "Moor"), (None, "Solo"), ("Solo", None), (" Bo", "Reed "), (None, None)], "a string, b string")
    names = [r[0] for r in rows.select(fn.full_name(F.col("a"), F.col("b"))).collect()]
    assert names == ["Ida Moor", "Solo", "Solo", "Bo Reed", ""]


def test_ratio(spark):
    rows = spark.createDataFrame([(1, 4), (1, 0), (None, 3)], "a int, b int")
    shares = [r[0] for r in rows.select(fn.ratio(F.col("a"), F.col("b"))).collect()]
    assert shares == [Decimal("0.25"), None, None]


def test_json_safe(spark):
    frame = spark.sql(
        "SELECT 1.50BD AS d, DATE'2031-03-08' AS day, TIMESTAMP'2031-03-08 19:30:00' AS t,"
        " TIMESTAMP_NTZ'2031-03-08 19:30:00.25' AS u, 7 AS n, 'x' AS s"
    )
    assert fn.json_safe(frame).first().asDict() == {
        "d": "1.50", "day": "2031-03-08", "t": "2031-03-08T19:30:00",
        "u": "2031-03-08T19:30:00.250000", "n": 7, "s": "x",
    }


def test_whole_numbers_keep_all_their_digits(spark):
    cells = ["1234567890123456789", " 9223372036854775807", "9223372036854775808", "-5", "12.0", "1e3", "x", "", None]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "i int, id string")
    found = [r.id for r in typed_cells(rows, {"id": "bigint"}).orderBy("i").collect()]
    assert found == [1234567890123456789, 9223372036854775807, None, -5, 12, 1000, None, None, None]


def test_plain_rows_of_a_file_are_typed_as_others(spark, tmp_path):
    layout = Layout("", "", {"a": "bigint", "b": "double", "note": "string"})
    cells = ["1234567890123456789", "9223372036854775808", "-5", "+5", "12.0", "5.", ".5", "2.5", "-", ".", "1-2", "+", "", "1e3", "1d", "0x1p3", " 7 ", "x"]
    numbers = spark.createDataFrame([(k, c or None) for k, c in enumerate(cells)], "i int, c string")
    wanted = typed_cells(numbers.select("i", F.col("c").alias("a"), F.col("c").alias("b")), {"a": "bigint", "b": "double"})
    # The second file's rows are never plain, since one of their cells has a letter.
    (tmp_path / "a.csv").write_text("a,b,note\n" + "".join(f"{c},{c},n{k}\n" for k, c in enumerate(cells)))
    (tmp_path / "b.csv").write_text("a,b,note\n" + "".join(f"{c},x,{k}\n{'x'},{c},{k}\n" for k, c in enumerate(cells)))
    rows = read_csv(spark, str(tmp_path), layout).collect()
    told = {r.i: (r.a, r.b) for r in wanted.collect()}
    assert {int(r.note[1:]): (r.a, r.b) for r in rows if r.note.startswith("n")} == told
    others = [(int(r.note), r.a, r.b) for r in rows if not r.note.startswith("n")]
    assert sorted(others, key=repr) == sorted([(k, a, None) for k, (a, _) in told.items()] + [(k, None, b) for k, (_, b) in told.items()], key=repr)


def test_number_cells_are_matched_once_a_row(spark, tmp_path):
    (tmp_path / "g.csv").write_text(",".join(GAMES.names) + "\n")
    plan = read_csv(spark, str(tmp_path), GAMES)._jdf.queryExecution().optimizedPlan().toString()
    # A filter on two of the cells asks the row's own column, not each cell again.
    assert plan.count("concat_ws") == 1
    filtered = read_csv(spark, str(tmp_path), GAMES).where("team_id_home <> team_id_away")
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1


def test_cells_with_line_breaks(spark, tmp_path):
    layout = Layout("", "", {"id": "int", "note": "string"})
    (tmp_path / "a b%.csv").write_text('id,note\n1,"one\ntwo, ""three"""\n2,plain\n3,"x\n\ny"\n2,later\n')
    (tmp_path / "c.csv").write_text('id,note\n4,"quoted ""well"""\n5,\n')
    rows = keep_last(read_csv(spark, str(tmp_path), layout), ["id"])
    assert {r.id: r.note for r in rows.collect()} == {1: 'one\ntwo, "three"', 2: "later", 3: "x\n\ny", 4: 'quoted "well"', 5: None}
    plain = read_csv(spark, str(tmp_path / "c.csv"), layout)
    assert plain.count() == 2 and "multiLine" not in plain._jdf.queryExecution().toString()


def test_feed_minutes_are_compiled(spark):
    # The JVM interprets methods of more than 8000 bytes, and other steps share the loop.
    rows = spark.range(1).select(F.col("id").cast("string").alias("minutes"))
    plan = rows.select(fn.parse_feed_minutes(F.col("minutes")))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) < 4000
