"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should
have. The whole part is taken at once; the fraction is settled in pairs: of two open
documents one gives words to the other, in a random direction that keeps both expected
values, until the fraction of one is 0 or 1. Each move keeps the source's sum of words
exactly, so only a last open document, rounded to the nearer side, adds an error.

Pairs are formed along a reduction tree. A document starts at a leaf drawn from its id;
a leaf streams its documents and passes on the one that stays open, then FAN_IN leaves
meet in a node, up to one node a source. A task holds one open document, whatever the
number of a leaf's rows, so a source with a third of all rows is spread over all leaves.
Within a node large documents come first, which leaves a small one open at the end.
Rows that agree in id, source and size are one document with a count: among equals the
pairing leaves all but one whole, so only that one goes to the tree, and a row that is
repeated a million times meets no task a million times. Random draws are hashes of the seed and the ids, so reruns and retries agree.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statledger.llm.tables import free_name
from statledger.session import written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
LEAVES, FAN_IN = 65536, 256
SEED = 20240


def word_count(text):
    """Runs of what is no ASCII space; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of each source in (source, source_size).

    Sources in order of their bytes, null last, take the weights in turn and share the
    given part of all words; a target stops at `most` times its source's size and the
    rest is shared again by weight. That is the level L at which the sum of
    min(most * size, weight * L) is the share, found by one pass over the sources in the
    order in which they fill up. The input has one row for each source, not for each document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    full = F.col("source_size") * F.lit(most)
    ranked = sizes.withColumn("weight", weight).withColumn("fills", full / F.col("weight"))
    up_to = Window.orderBy("fills", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    filled = F.coalesce(F.sum(full).over(up_to), F.lit(0.0))
    open_weight = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    level = (F.sum("source_size").over(total) * share - filled) / open_weight
    ranked = ranked.withColumn("level", level)
    # The level is right at the first source that it doesn't fill.
    right = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(total)["level"]
    return ranked.withColumn("right", right).select(
        "source", "source_size",
        F.least(F.col("source_size") * F.lit(most), F.col("weight") * F.coalesce("right", "fills")).alias("target"),
    )


def plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, n, source_size, target, whole and more of each distinct (doc_id, source, size).

    Of the n rows that agree in them, `more` are taken whole + 1 times and the others whole
    times, 0 to 2 in all. A document without words is taken as often as its whole part says.
    A null source is a source; a null id draws like any other id. An empty table has no rows.
    """
    same = docs.groupBy("doc_id", "source", F.col("size").cast("long").alias("size")).agg(F.count("*").alias("n"))
    sized = written(same, "sizes")
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sizes).select(F.col("source").alias("goal_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # One row for each source; where those aren't few, the join splits a hot source's documents.
    rows = sized.join(goals, F.col("source").eqNullSafe(F.col("goal_source")), "left").drop("goal_source")
    whole = F.floor(rate + F.lit(1e-12))
    fraction = F.greatest(rate - whole, F.lit(0.0))
    fraction = F.when((F.col("size") > 0) & (fraction > 1e-12), fraction).otherwise(F.lit(0.0))
    sure = F.floor(fraction * F.col("n") + F.lit(1e-9))
    rest = fraction * F.col("n") - sure
    rows = rows.select(
        "*", whole.cast("int").alias("whole"), sure.cast("long").alias("sure"),
        F.when(rest > 1e-9, rest).otherwise(F.lit(0.0)).alias("p"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size").alias("draw"),
    ).withColumn("node", F.pmod("draw", F.lit(LEAVES)))
    open_now, done = rows, None
    leaves = LEAVES
    while True:
        settled = written(_settle(open_now, last=leaves == 1), "mix")
        closed = settled.where("p = 0 or p = 1")
        done = closed if done is None else done.unionByName(closed)
        if leaves == 1:
            break
        leaves = -(-leaves // FAN_IN)
        open_now = settled.where("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / FAN_IN))
    return done.select("doc_id", "source", "size", "n", "source_size", "target", "whole",
                       (F.col("sure") + F.col("p").cast("long")).alias("more"))


def _settle(rows: DataFrame, last: bool) -> DataFrame:
    """The rows with all but one of each (source, node) at p 0 or 1; that one too if last."""
    sort = ["source", "node", F.desc("size"), "draw", "doc_id"]
    dealt = rows.repartition("source", "node").sortWithinPartitions(*sort)

    def run(frames):
        held = None
        for frame in frames:
            out, held = _walk(frame, held, last)
            if len(out):
                yield out
        if held is not None:
            yield _one(held, last)

    return dealt.mapInPandas(run, rows.schema)


def _one(held, last):
    frame, p = held
    return frame.assign(p=float(round(p)) if last and 0 < p < 1 else p)


def _walk(frame: pd.DataFrame, held, last):
    """Settles a run of rows; (settled rows, open row that the next run goes on with)."""
    if held is not None:
        frame = pd.concat([held[0].assign(p=held[1]), frame], ignore_index=True)
    p = frame["p"].to_numpy(float, copy=True)
    size, draw = frame["size"].tolist(), frame["draw"].tolist()
    source = frame["source"].where(frame["source"].notna(), None).tolist()
    node = frame["node"].tolist()
    at = None
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if at is None or (source[at], node[at]) != (source[k], node[k]):
            if at is not None and last:
                p[at] = round(p[at])
            at = k
            continue
        p[at], p[k] = _exchange(size[at], p[at], size[k], p[k], draw[at], draw[k])
        at = at if 0 < p[at] < 1 else k if 0 < p[k] < 1 else None
    if at is None:
        return frame.assign(p=p), None
    rest = frame.iloc[[at]]
    keep = np.ones(len(p), bool)
    keep[at] = False
    return frame.assign(p=p)[keep], (rest, float(p[at]))


def _exchange(size_a, p_a, size_b, p_b, draw_a, draw_b):
    """The fractions after words moved from one document to the other until one is whole."""
    to_a = min((1 - p_a) * size_a, p_b * size_b)
    to_b = min(p_a * size_a, (1 - p_b) * size_b)
    u = xxhash.xxh64_intdigest(f"{draw_a},{draw_b}") / 2.0**64
    if u * (to_a + to_b) < to_b:
        if (1 - p_a) * size_a <= p_b * size_b:
            return 1.0, _near(p_b - to_a / size_b)
        return _near(p_a + to_a / size_a), 0.0
    if p_a * size_a <= (1 - p_b) * size_b:
        return 0.0, _near(p_b + to_b / size_b)
    return _near(p_a - to_b / size_a), 1.0


def _near(p):
    """p, or 0 or 1 if it differs from it by rounding errors only."""
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    planned = plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    # A document's equal rows again, in parts of some thousand that are dealt to all tasks.
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _PART))
    part = planned.withColumn("part", F.explode(parts)).repartition("doc_id", "size", "part")
    first = F.col("part") * _PART
    rows = part.withColumn("row", F.explode(F.sequence(first, F.least(first + _PART, F.col("n")) - 1)))
    copies = F.col("whole") + (F.col("row") < F.col("more")).cast("int")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


_PART = 4096


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with each row as often as the mix takes it, and the number of the copy from 1.

    Rows that agree in id, source and size share their copies: `more` of them, whichever, are
    taken once more than the others. Only the rows of groups that differ so are numbered.
    """
    columns = {"doc_id": doc_id, "source": source, "size": free_name(docs, "mix_size")}
    more, copy, number, mark = (free_name(docs, n) for n in ("mix_more", "copy_no", "mix_number", "mix_mark"))
    planned = plan(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    # Rows are numbered, which takes another pass over the texts, only if any group's copies differ.
    any_differ = not planned.where("more > 0 and more < n").isEmpty()
    planned = planned.select(F.struct("doc_id", "source", "size").alias(mark), F.struct("n", "whole", "more").alias(more))
    match = F.lit(True)
    for name, column in columns.items():
        match = match & F.col(column).eqNullSafe(F.col(f"{mark}.{name}"))
    sized = docs.withColumn(columns["size"], word_count(F.col(text)))
    rows = sized.join(planned, match)
    count, extra = F.col(f"{more}.n"), F.col(f"{more}.more")
    differ = (extra > 0) & (extra < count)
    chosen = (rows.where(~differ) if any_differ else rows).withColumn(number, F.lit(0).cast("long"))
    if any_differ:
        chosen = chosen.unionByName(_numbered(rows.where(differ), mark, number))
    copies = F.col(f"{more}.whole") + (F.col(number) < extra).cast("int")
    repeated = chosen.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return repeated.select(*docs.columns, copy)


def _numbered(rows: DataFrame, mark: str, number: str) -> DataFrame:
    """The rows with numbers from 0 among those of one mark.

    A row's number is its rank in the task that read it plus the counts of the tasks before, so equal
    rows are not gathered to be numbered.
    """
    place, task = free_name(rows, "mix_place"), free_name(rows, "mix_task")
    settled = written(rows.withColumn(place, F.monotonically_increasing_id()), "repeats")
    narrow = settled.select(place, mark).withColumn(task, F.shiftright(place, 33))
    rank = F.row_number().over(Window.partitionBy(mark, task).orderBy(place)) - 1
    counts = narrow.groupBy(mark, task).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(mark).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(F.col(mark).alias("of"), F.col(task).alias("of_task"), F.coalesce(before, F.lit(0)).alias("first"))
    ranked = narrow.withColumn("rank", rank).join(
        firsts, F.col(mark).eqNullSafe(F.col("of")) & (F.col(task) == F.col("of_task")))
    numbers = ranked.select(F.col(place).alias("at"), (F.col("rank") + F.col("first")).alias("numbered"))
    numbers = numbers.select(F.col("at").alias(f"{place}_of"), F.col("numbered").alias(number))
    return settled.join(numbers, F.col(place) == F.col(f"{place}_of")).drop(place, f"{place}_of")
