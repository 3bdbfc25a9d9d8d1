"""Guarded, row-capped ad-hoc SELECT queries.

A query runs in a session of its own, which knows the given tables and nothing else. Its
text is put into a subquery, so nothing but a query can be parsed; Spark analyses that, and
nothing runs before the analysed plan is vetted: its nodes, the tables it reads, and every
expression, which must be plain syntax or one of the listed functions. Before it starts, the
optimizer's size estimates keep out joins of everything with everything.
"""

import threading
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from statledger.fixed_values import ADHOC_FUNCTIONS, ADHOC_ROW_CAP, ADHOC_TIMEOUT_MS
from statledger.functions import json_safe

# Roots of one SELECT, below its ORDER BY, LIMIT, OFFSET and WITH.
_ROOTS = {"Project", "Aggregate", "Filter", "Distinct"}
_WRAPPERS = {"Sort", "GlobalLimit", "LocalLimit", "Offset"}
_SET_OPERATIONS = {"Union", "Intersect", "Except"}
_NODES = _ROOTS | _WRAPPERS | _SET_OPERATIONS | {
    "Join", "LateralJoin", "Window", "Expand", "SubqueryAlias", "View", "WithCTE", "CTERelationDef", "CTERelationRef",
    "LocalRelation", "ResolvedInlineTable", "OneRowRelation",
}
# What operators, CASE, CAST, subqueries and windows are made of. Invoke and StaticInvoke stand inside
# some functions; no text makes one by itself.
_SYNTAX = {
    "Alias", "AttributeReference", "OuterReference", "Literal", "Cast", "SortOrder", "AggregateExpression",
    "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnspecifiedFrame", "CurrentRow",
    "UnboundedPreceding", "UnboundedFollowing", "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan",
    "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Between", "In", "InSet", "InSubquery", "IsNull", "IsNotNull",
    "IsNaN", "Like", "ILike", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny", "CaseWhen", "If", "Add", "Subtract",
    "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "ScalarSubquery", "Exists",
    "ListQuery", "LateralSubquery", "GetStructField", "DateAddInterval", "DateDiff", "DateAdd", "DateSub",
    "SubtractDates", "TimeAdd", "TimestampAddInterval", "Invoke", "StaticInvoke", "CheckOverflow", "KnownNotNull", "GroupingID",
    "Grouping", "With", "CommonExpressionDef", "TypedNullLiteral", "CommonExpressionRef", "ExtractANSIIntervalDays", "DateAddYMInterval",
}
# Settings of the queries' sessions: no files as tables, no pipe syntax.
_SETTINGS = {"spark.sql.runSQLOnFiles": "false", "spark.sql.operatorPipeSyntaxEnabled": "false"}
# A join without an equality is refused beyond this product of its sides' estimated bytes.
PAIR_BYTES = 10**13


class UnsafeQueryError(ValueError):
    """The text is not one plain SELECT over the allowed tables."""


def _items(sequence):
    return [sequence.apply(i) for i in range(sequence.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_root(plan) -> None:
    while _kind(plan) in _WRAPPERS | {"WithCTE"}:
        plan = plan.plan() if _kind(plan) == "WithCTE" else plan.child()
    if _kind(plan) in _SET_OPERATIONS or _kind(plan) == "Distinct" and _kind(plan.child()) in _SET_OPERATIONS:
        raise UnsafeQueryError("Only a single SELECT is allowed, got a set operation")
    if _kind(plan) not in _ROOTS:
        raise UnsafeQueryError(f"Only SELECT statements are allowed, got {_kind(plan)}")


def _check_plan(plan, functions: set) -> None:
    kind = _kind(plan)
    if kind not in _NODES:
        raise UnsafeQueryError(f"{kind} is not allowed")
    if kind == "View":
        # Views of the session are the given tables; one of the catalog is none of them.
        if not plan.isTempView():
            raise UnsafeQueryError("Only the given tables are allowed")
        return
    for expression in _items(plan.expressions()):
        _check_expression(expression, functions)
    for child in _items(plan.children()):
        _check_plan(child, functions)


def _check_expression(expression, functions: set) -> None:
    kind, name = _kind(expression), expression.getClass().getName()
    if kind not in _SYNTAX and name.rstrip("$") not in functions:
        raise UnsafeQueryError(f"Function {expression.prettyName()} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _check_plan(expression.plan(), functions)
    for child in _items(expression.children()):
        _check_expression(child, functions)


@lru_cache(maxsize=1)
def _function_classes(spark: SparkSession) -> frozenset:
    """The classes that Spark's catalog names for the listed functions."""
    found = set()
    for name in ADHOC_FUNCTIONS:
        for row in spark.sql(f"DESCRIBE FUNCTION {name}").collect():
            if row[0].startswith("Class: "):
                found.add(row[0].removeprefix("Class: ").rstrip("$"))
    return frozenset(found)


def _check_pairs(plan, most: int) -> None:
    """Refuses a join that compares all rows of both sides, if those are many."""
    if _kind(plan) == "Join":
        condition = plan.condition()
        if condition.isEmpty() or not _has_equality(condition.get()):
            pairs = 1
            for side in (plan.left(), plan.right()):
                pairs *= int(str(side.stats().sizeInBytes()))
            if pairs > most:
                raise UnsafeQueryError("A join without an equality is too large")
    for expression in _items(plan.expressions()):
        for inner in _subplans(expression):
            _check_pairs(inner, most)
    for child in _items(plan.children()):
        _check_pairs(child, most)


def _has_equality(condition) -> bool:
    if _kind(condition) == "And":
        return any(_has_equality(side) for side in _items(condition.children()))
    return _kind(condition) in ("EqualTo", "EqualNullSafe")


def _subplans(expression):
    if hasattr(expression, "plan") and _kind(expression) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        yield expression.plan()
    for child in _items(expression.children()):
        yield from _subplans(child)


def private_session(spark: SparkSession, tables: dict) -> SparkSession:
    """A session that shares nothing but the cluster and the catalog, with the tables as its views.

    `tables` maps names to functions that give the table in a session.
    """
    session = spark.newSession()
    for key, value in _SETTINGS.items():
        session.conf.set(key, value)
    for name, table in tables.items():
        table(session).createOrReplaceTempView(name)
    return session


def capped(sql: str, rows: int) -> str:
    """The text that is run: the query as a subquery, of which at most so many rows are taken."""
    return f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n) AS adhoc LIMIT {rows}"


def vetted(session: SparkSession, text: str, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """Lazy result of a text of capped(); UnsafeQueryError unless it holds one SELECT over the session's views."""
    try:
        frame = session.sql(text)
    except Exception as error:
        raise UnsafeQueryError(f"Not a query over the given tables: {error}") from error
    execution = frame._jdf.queryExecution()
    inner = execution.analyzed()
    for kind in ("GlobalLimit", "LocalLimit", "Project", "SubqueryAlias"):
        if _kind(inner) != kind:
            raise UnsafeQueryError("Only one query is allowed")
        inner = inner.child()
    _check_root(inner)
    _check_plan(inner, _function_classes(session))
    _check_pairs(execution.optimizedPlan(), pair_bytes)
    return frame


def vet(spark: SparkSession, sql: str, tables: dict) -> None:
    """Raises UnsafeQueryError unless the text is one SELECT over the given tables."""
    vetted(private_session(spark, tables), capped(sql, 1))


def guarded_select(spark: SparkSession, sql: str, tables: dict, row_cap: int = ADHOC_ROW_CAP) -> DataFrame:
    """Lazy result of a vetted SELECT, at most row_cap rows.

    The cap stands outside the query, so its own smaller limit stays in force.
    """
    return json_safe(vetted(private_session(spark, tables), capped(sql, row_cap)))


def run_query(
    spark: SparkSession,
    sql: str,
    tables: dict,
    row_cap: int = ADHOC_ROW_CAP,
    timeout_ms: int = ADHOC_TIMEOUT_MS,
) -> dict:
    """{"sql", "rows", "truncated"} of a SELECT, or {"error"}; never raises for a bad query.

    "sql" is the text that was run. It asks for one row beyond the cap, which is not
    returned but makes "truncated" true.
    """
    tag = f"adhoc-{uuid.uuid4().hex}"
    finished = threading.Event()
    watch = threading.Thread(
        target=_cancel_late, args=(spark, tag, timeout_ms / 1000, finished), daemon=True
    )
    spark.sparkContext.addJobTag(tag)
    watch.start()
    try:
        text = capped(sql, row_cap + 1)
        result = json_safe(vetted(private_session(spark, tables), text))
        names = _distinct_names(result.columns)
        rows = [dict(zip(names, row, strict=True)) for row in result.collect()]
    except Exception as error:
        return {"error": str(error)}
    finally:
        finished.set()
        spark.sparkContext.removeJobTag(tag)
    return {"sql": text, "rows": rows[:row_cap], "truncated": len(rows) > row_cap}


def _distinct_names(names: list) -> list:
    """The names, with a number after those that stand to the left already."""
    out = []
    for name in names:
        number, free = 2, name
        while free in out:
            number, free = number + 1, f"{name}_{number}"
        out.append(free)
    return out


def _cancel_late(spark: SparkSession, tag: str, seconds: float, finished: threading.Event) -> None:
    """Cancels the tagged jobs once their time is over, again until the query ends: a
    cancellation that comes before a job has started finds nothing to stop."""
    if finished.wait(seconds):
        return
    while not finished.wait(0.25):
        spark.sparkContext.cancelJobsWithTag(tag)
