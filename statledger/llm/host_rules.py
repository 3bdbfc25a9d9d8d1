"""Quality rules of documents and of their hosts, in DataFrame functions only.

Rules judge each document: too few words, repeated passages, symbols, repeated lines. A
host's rate of failing documents is shrunk towards that of all hosts by a beta prior
whose mean and weight come from the hosts' own rates, so a host with few documents isn't
judged by them alone. Documents of a host whose shrunk rate is above MOST_FAILED go, too.

Counts are summed in the tasks before they are shuffled, and only hosts, not documents, are
joined; a host with a third of all documents is one row of that join.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statledger.llm.tables import NOT_SPACE
from statledger.session import written

FEWEST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20  # percent of the words
MOST_SYMBOLS = 30  # to 100 words
MOST_REPEATED_LINES = 50  # percent of the lines with a word
MOST_FAILED = 0.5
_SPACE = r"[\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of doc_id, source, text.

    A null text has no words. Two five-word windows count as equal if their 64-bit hashes are.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", "source",
        F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0)).alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(_SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE)).alias("lines"),
    )
    last = F.size("words") - WINDOW + 1
    hashes = F.when(last > 0, F.transform(
        F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    hashed = base.select(
        "doc_id", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    repeated = hashed.withColumn(
        "ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(
            F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.coalesce(F.get("ordered", j)["h"] == F.get("ordered", k)["h"], F.lit(False))
    found = F.filter(F.transform(
        F.sequence(F.lit(0), F.size("ordered") - 1),
        lambda j: F.when(((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | same(j, j + 1), F.get("ordered", j)["i"]),
    ), lambda i: i.isNotNull())
    placed = repeated.drop("hashes").withColumn("starts", F.when(F.col("ordered").isNotNull(), F.sort_array(found))).drop("ordered")
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def base_failed():
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rule_failed():
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MOST_REPEATED_LINES * F.col("n_lines"))
    )


def host_verdicts(counts: DataFrame) -> DataFrame:
    """(source, host_docs, host_failed, host_rate, host_kept); a null source is a host of its own."""
    hosts = counts.groupBy("source").agg(
        F.count("*").alias("host_docs"), F.sum(rule_failed().cast("long")).alias("host_failed"))
    hosts = written(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    row = hosts.agg(F.sum("host_failed").alias("failed"), F.sum("host_docs").alias("docs"),
                    F.var_samp(rate).alias("spread"), F.avg(1 / F.col("host_docs")).alias("noise")).first()
    mean = (row["failed"] + 0.5) / (row["docs"] + 1) if row["docs"] else 0.5
    # What single documents add to the spread of rates isn't the hosts' own.
    own = max((row["spread"] or 0.0) - mean * (1 - mean) * (row["noise"] or 0.0), 1e-6)
    weight = min(max(mean * (1 - mean) / own - 1, 2.0), 10_000.0)
    shrunk = (F.col("host_failed") + mean * weight) / (F.col("host_docs") + weight)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", shrunk <= MOST_FAILED)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    host_docs, host_failed of every document; repeated rows are documents of their own. A null text has
    no words and fails; a null source is a host; an empty table has no rows."""
    counts = written(with_counts(docs.select("doc_id", "source", "text")), "rules")
    verdicts = host_verdicts(counts).select(F.col("source").alias("host"), "host_docs", "host_failed", "host_kept")
    judged = counts.join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.col("host_kept")).alias("kept"),
        "host_docs", "host_failed")
