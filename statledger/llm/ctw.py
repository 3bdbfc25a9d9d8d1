"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision, named by the bits before it in its byte,
has a context tree over the bytes before: the node of a context holds how often either bit
followed it, and gives the Krichevsky-Trofimov estimate of its counts. Bottom up, a node's
weighted probability is the half sum of its own estimate and the product of its children's;
so a prediction mixes the estimates of all depths up to DEPTH along the context's path, each
depth with the weight that the training texts have earned it.

Training counts all runs of DEPTH + 1 bytes in each task and adds them up in Spark; nodes of
all depths are sums of these counts, and none is left out. The nodes beneath one suffix of
SUFFIX bytes are a subtree that no corpus makes larger than 256 ** (DEPTH - SUFFIX) contexts;
Spark deals the subtrees to the tasks, and only the weights of the nodes above them, at most
256 contexts, go through the driver. The mixed probabilities of the MOST_CONTEXTS most frequent
contexts travel to every task as a table. A text's other runs are listed, the subtrees give
each distinct one its probability, in training or not, and a join brings it back to the text.

Word counts, which have no bound, stay in Spark: all words are counted, the FREQUENT most
frequent travel with the model, and the others meet their counts in a join.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField

from statledger.llm.tables import append_columns, fold, held_out, pieces, values_of
from statledger.session import written

DEPTH = 4
SUFFIX = 2
MOST_CONTEXTS = 40_000
FREQUENT = 50_000
FOLDS, HELD_OUT = 5, 1
END = 0
_DECISIONS = 16
_LOG10_2 = float(np.log10(2.0))


def text_bytes(data: bytes) -> np.ndarray:
    """The text with A-Z lowered, a zero byte at its end, and DEPTH zero bytes of context before it."""
    return np.frombuffer(bytes(DEPTH) + data.lower() + bytes([END]), np.uint8)


def _runs(texts: list) -> np.ndarray:
    """All runs of DEPTH + 1 bytes of the texts, as numbers; none spans two texts."""
    joined = np.concatenate([text_bytes(t) for t in texts]).astype(np.uint64)
    codes = np.zeros(len(joined) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        codes = (codes << np.uint64(8)) | joined[k:len(joined) - DEPTH + k]
    ends = np.cumsum([len(t) + DEPTH + 1 for t in texts])
    keep = np.ones(len(codes), bool)
    # A run that ends in the context bytes before a later text belongs to no text.
    for k in range(DEPTH):
        inner = ends[:-1] + k - DEPTH
        keep[inner] = False
    return codes[keep]


def count_runs(docs: DataFrame, at_once: int = 1 << 21) -> DataFrame:
    """(run, n): how often each run of DEPTH + 1 bytes occurs in the texts."""
    def run(batches):
        lot, size = [], 0
        for batch in pieces(batches, "text"):
            for data in values_of(batch, "text"):
                lot.append(data)
                size += len(data) + DEPTH + 1
                if size >= at_once:
                    yield counted(lot)
                    lot, size = [], 0
        if lot:
            yield counted(lot)

    def counted(lot):
        codes, n = np.unique(_runs(lot), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["run", "n"])

    return docs.select("text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def node_counts(runs: DataFrame, deepest: int = DEPTH) -> list:
    """For each depth down to the deepest the counts (context, byte, n) of all its contexts, in order.

    Depths below SUFFIX have 65,536 rows at most; the deeper ones grow with the corpus."""
    levels = []
    for depth in range(deepest + 1):
        code = F.col("run").bitwiseAND((1 << 8 * (depth + 1)) - 1)
        level = runs.select(F.shiftrightunsigned(code, 8).alias("context"), code.bitwiseAND(255).alias("byte"), "n")
        rows = level.groupBy("context", "byte").agg(F.sum("n").alias("n")).orderBy("context", "byte").toPandas()
        levels.append((rows["context"].to_numpy(np.int64), rows["byte"].to_numpy(np.int64), rows["n"].to_numpy(float)))
    return levels


def _levels(run, n, above: list) -> list:
    """The counts of all depths, of which those below SUFFIX are given, from the runs of whole subtrees."""
    levels = list(above)
    for depth in range(SUFFIX, DEPTH + 1):
        codes, place = np.unique(run & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        levels.append((codes >> 8, codes & 255, np.bincount(place, n, len(codes))))
    return levels


def _by_subtree(runs: DataFrame, make, schema: str) -> DataFrame:
    """make() runs once in each task and returns a function from the columns of whole subtrees' rows to columns."""
    suffix = F.shiftrightunsigned("run", 8).bitwiseAND((1 << 8 * SUFFIX) - 1)
    dealt = runs.withColumn("suffix", suffix).repartition("suffix").sortWithinPartitions("suffix")
    names = runs.columns

    def run(batches):
        compute = make()
        held, size, most = [], 0, _RUNS_AT_ONCE

        def computed(rows):
            out = compute(*[rows.column(name).to_numpy() for name in names])
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            suffixes = rows.column("suffix").to_numpy()
            # The last subtree may go on in the next batch.
            end = int(np.searchsorted(suffixes, suffixes[-1]))
            if end:
                yield computed(rows.slice(0, end))
            held, size = rows.slice(end).to_batches(), size - end
            most = max(_RUNS_AT_ONCE, 2 * size)
        if size:
            yield computed(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def _log_kt(zeros, ones):
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    total = zeros + ones
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(total + 1.0) - np.log(np.pi)


def _lgamma(x):
    """Log gamma for positive x by Stirling's series, from x + 8 down."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _mixed_log(zeros, ones, product):
    """Log odds of nodes' own estimates against their children's product, and log of the half sum of both."""
    seen = np.flatnonzero(zeros + ones)
    own = np.zeros(len(zeros))
    own[seen] = _log_kt(zeros[seen], ones[seen])
    return own - product, np.logaddexp(own, product) - np.log(2.0)


class Tree:
    """The nodes of all depths, and the weights of their estimates."""

    def __init__(self, levels: list):
        self.levels = levels
        symbols = levels[0][1]
        self.symbols = np.append(symbols, -1)  # the last one stands for bytes that training lacks
        self.width = len(symbols) + 1
        contexts = [np.unique(c) for c, _, _ in levels]
        contexts[0] = np.zeros(1, np.int64)
        self.contexts = contexts
        self.first = np.append(0, np.cumsum([len(c) for c in contexts]))

    def bits(self, low):
        """By depth the zeros and ones of its nodes, a flat (node, decision) each, for the decisions from low on.

        A decision is the bits before it in its byte with a one put in front."""
        return [self._bit_counts(d, low, *level) for d, level in enumerate(self.levels)]

    def _bit_counts(self, d, low, context, byte, n):
        node = np.searchsorted(self.contexts[d], context)
        counts = np.zeros((2, len(self.contexts[d]) * _DECISIONS))
        for bit in range(8):
            prefix = (1 << bit) | (byte >> (8 - bit))
            value = (byte >> (7 - bit)) & 1
            here = (prefix >= low) & (prefix < low + _DECISIONS)
            for v in (0, 1):
                some = here & (value == v)
                counts[v] += np.bincount(node[some] * _DECISIONS + prefix[some] - low, n[some], counts.shape[1])
        return counts

    def _places(self, depth, context):
        """Flat places of all decisions at the nodes of the contexts' suffixes of a depth."""
        node = np.searchsorted(self.contexts[depth], context & ((1 << 8 * depth) - 1))
        return (node[:, None] * _DECISIONS + np.arange(_DECISIONS)).ravel()

    def weights(self, bits, deepest=DEPTH, top=0, product=None):
        """By depth from the deepest up to the top one the log odds of a node's own estimate against its
        children's product, and the weighted logs of the top depth's nodes. The product of the deepest
        depth's children is given, unless they are leaves."""
        odds = [None] * DEPTH
        if product is None:
            zeros, ones = bits[DEPTH]
            seen = np.flatnonzero(zeros + ones)
            below = np.zeros(len(zeros))
            below[seen] = _log_kt(zeros[seen], ones[seen])
            deepest = DEPTH - 1
        for d in range(deepest, top - 1, -1):
            if product is None:
                product = np.bincount(self._places(d, self.contexts[d + 1]), below, len(bits[d][0]))
            odds[d], below = _mixed_log(*bits[d], product)
            product = None
        return odds, below


class Model(Tree):
    """Tables of log10 probabilities of the next byte by node, and how to find a context's node.

    The levels hold the whole tree, or whole subtrees and all nodes above them; then `above` holds,
    by first decision, the odds of the depths below SUFFIX, which the whole tree decides."""

    def __init__(self, levels: list, above: dict = None):
        super().__init__(levels)
        self.table = np.zeros((self.first[-1], self.width), np.float32)
        # The trees of different decisions share no node, so some of them are built at a time.
        for low in range(0, 256, _DECISIONS):
            bits = self.bits(low)
            odds, _ = self.weights(bits, top=SUFFIX if above else 0)
            self._mix(low, bits, above[low] + odds[SUFFIX:] if above else odds)
        missing = 1.0 - (10.0 ** self.table[:, :-1]).sum(axis=1, dtype=float)
        spare = max(1, 256 - (self.width - 1))
        self.table[:, -1] = np.log10(np.maximum(missing, 1e-9) / spare)

    def _mix(self, low, bits, odds):
        """Adds the log10 chances of the decisions from low on to the table.

        The prediction at the end of a path is the estimate there; above it, a node's estimate and
        the deeper prediction are mixed by the odds. A context without a deeper node predicts by its
        own estimate, which is why the table has rows for nodes of every depth.
        """
        chances = [(ones + 0.5) / (zeros + ones + 1.0) for zeros, ones in bits]
        for d in range(DEPTH + 1):
            mixed = chances[d]
            for e in range(d - 1, -1, -1):
                place = self._places(e, self.contexts[d])
                share = 1.0 / (1.0 + np.exp(np.clip(odds[e][place], -60, 60)))
                mixed = share * mixed + (1 - share) * chances[e][place]
            mixed = mixed.reshape(-1, _DECISIONS)
            rows = slice(self.first[d], self.first[d + 1])
            for k, symbol in enumerate(self.symbols[:-1].tolist()):
                for bit in range(8):
                    decision = ((1 << bit) | (symbol >> (8 - bit))) - low
                    if 0 <= decision < _DECISIONS:
                        one = mixed[:, decision]
                        self.table[rows, k] += np.log10(one if (symbol >> (7 - bit)) & 1 else 1 - one)

    def state(self):
        return self.contexts, self.symbols, self.table


class Scorer:
    """Code lengths of texts from a model's tables, a batch of bytes at once.

    The table has a row for every node, or, if not `whole`, for some nodes of the last depth only;
    runs of other contexts are then left to the caller."""

    def __init__(self, contexts, symbols, table, whole=True):
        self.table, self.width, self.whole = table, table.shape[1], whole
        self.symbol = np.full(256, self.width - 1, np.int64)
        self.symbol[symbols[:-1]] = np.arange(self.width - 1)
        self.first = np.append(0, np.cumsum([len(c) for c in contexts]))
        # next[d][node of the d newest bytes but one, the byte further back] leads one depth down.
        self.next = []
        for d in range(DEPTH):
            step = np.full((len(contexts[d]), self.width), -1, np.int32)
            context = contexts[d + 1]
            parent = np.searchsorted(contexts[d], context & ((1 << 8 * d) - 1))
            older = (context >> 8 * d) & 255
            step[parent, self.symbol[older]] = np.arange(len(context))
            self.next.append(step)

    def score(self, texts: list) -> list:
        """log10 probability of each text and its end."""
        return self.score_known(texts)[0]

    def score_known(self, texts: list) -> tuple:
        """For each text the log10 probability of it and its end without the runs left to the caller,
        these runs, and how often each occurs."""
        out, lot, size = ([], [], []), [], 0

        def add(found):
            for column, values in zip(out, found, strict=True):
                column.extend(values)

        for data in texts:
            if len(data) > _AT_ONCE:
                add(self._lot(lot))
                add(self._long(data))
                lot, size = [], 0
                continue
            lot.append(data)
            size += len(data)
            if size >= _AT_ONCE:
                add(self._lot(lot))
                lot, size = [], 0
        add(self._lot(lot))
        return out

    def _long(self, data):
        whole = text_bytes(data)
        total, left = 0.0, []
        for k in range(DEPTH, len(whole), _AT_ONCE):
            part = whole[max(0, k - DEPTH):k + _AT_ONCE]
            values, open_now = self._values(part)
            total += values.sum()
            left.append(_codes(part, open_now))
        runs, times = np.unique(np.concatenate(left), return_counts=True)
        return [float(total)], [runs.tolist()], [times.tolist()]

    def _lot(self, lot):
        if not lot:
            return [], [], []
        joined = np.concatenate([text_bytes(t) for t in lot])
        found, open_now = self._values(joined)
        values = np.append(np.zeros(DEPTH), found)
        sizes = np.array([len(t) + DEPTH + 1 for t in lot])
        starts = np.append(0, np.cumsum(sizes)[:-1])
        # The context bytes before a text are no part of it.
        for k in range(DEPTH):
            values[starts + k] = 0.0
        runs, times = [[] for _ in lot], [[] for _ in lot]
        text = np.searchsorted(starts, open_now + DEPTH, "right") - 1
        own = open_now + DEPTH - starts[text] >= DEPTH
        if own.any():
            text, codes = text[own], _codes(joined, open_now[own])
            order = np.lexsort((codes, text))
            text, codes = text[order], codes[order]
            firsts = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(codes) != 0)))
            counts = np.diff(np.append(firsts, len(text)))
            for t, code, n in zip(text[firsts].tolist(), codes[firsts].tolist(), counts.tolist(), strict=True):
                runs[t].append(code)
                times[t].append(n)
        return np.add.reduceat(values, starts).tolist(), runs, times

    def _values(self, joined):
        """log10 probability of each byte from the DEPTH-th on, 0 for those left to the caller, and their places."""
        symbols = self.symbol[joined]
        n = len(joined) - DEPTH
        row = self._rows([symbols[DEPTH - 1 - d:DEPTH - 1 - d + n] for d in range(DEPTH)])
        if self.whole:
            return self.table[row, symbols[DEPTH:]].astype(float), np.zeros(0, np.int64)
        row -= self.first[DEPTH]
        open_now = np.flatnonzero(row < 0)
        values = np.zeros(n)
        if len(open_now) < n:
            row[open_now] = 0
            values[:] = self.table[row, symbols[DEPTH:]]
            values[open_now] = 0.0
        return values, open_now

    def _rows(self, older):
        """Rows of the deepest nodes of contexts, given their bytes' symbols from the newest byte on."""
        n = len(older[0])
        row = np.zeros(n, np.int64)
        node, open_now = np.zeros(n, np.int64), np.arange(n)
        for d in range(DEPTH):
            node = self.next[d][node, older[d] if len(open_now) == n else older[d][open_now]]
            found = node >= 0
            if not found.all():
                open_now, node = open_now[found], node[found]
            row[open_now] = node + self.first[d + 1]
        return row

    def of_runs(self, runs):
        """log10 probability of the last byte of each run."""
        older = [self.symbol[(runs >> 8 * (d + 1)) & 255] for d in range(DEPTH)]
        return self.table[self._rows(older), self.symbol[runs & 255]].astype(float)


def _codes(joined, places):
    """The runs that start at these places, as numbers."""
    codes = np.zeros(len(places), np.int64)
    for k in range(DEPTH + 1):
        codes = (codes << 8) | joined[places + k]
    return codes


def _top(runs: DataFrame) -> tuple:
    """The counts of the depths below SUFFIX, and by first decision the log odds of their nodes."""
    levels = node_counts(runs, SUFFIX - 1)
    if not len(levels[0][0]):
        return levels, {}

    def make():
        def compute(run, n):
            tree = Tree(_levels(run, n, levels))
            context = tree.contexts[SUFFIX]
            found = []
            for low in range(0, 256, _DECISIONS):
                _, below = tree.weights(tree.bits(low), top=SUFFIX)
                some = np.flatnonzero(below)
                found.append((context[some // _DECISIONS], some % _DECISIONS + low, below[some]))
            parts = [np.concatenate(column) for column in zip(*found, strict=True)]
            return dict(zip(("context", "decision", "weighted"), map(pa.array, parts), strict=True))

        return compute

    logs = _by_subtree(runs.select("run", "n"), make, "context long, decision long, weighted double")
    parent = F.col("context").bitwiseAND((1 << 8 * (SUFFIX - 1)) - 1)
    # Decimals add up to the same sum in any order.
    sums = logs.groupBy(parent.alias("context"), "decision").agg(
        F.sum(F.col("weighted").cast("decimal(28,12)")).cast("double").alias("product")).toPandas()
    nothing = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * (DEPTH + 1 - SUFFIX)
    tree = Tree(levels + nothing)
    products = np.zeros((len(tree.contexts[SUFFIX - 1]), 256))
    products[np.searchsorted(tree.contexts[SUFFIX - 1], sums["context"].to_numpy(np.int64)),
             sums["decision"].to_numpy(np.int64)] = sums["product"].to_numpy(float)
    above = {}
    for low in range(0, 256, _DECISIONS):
        product = products[:, low:low + _DECISIONS].ravel()
        above[low] = tree.weights(tree.bits(low), SUFFIX - 1, 0, product)[0][:SUFFIX]
    return levels, above


def _frequent_state(runs: DataFrame, top) -> tuple:
    """Contexts, symbols and table of the most frequent contexts of the last depth, for a Scorer that isn't whole."""
    context = F.shiftrightunsigned("run", 8)
    most = runs.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    most = most.orderBy(F.desc("total"), "context").limit(MOST_CONTEXTS).select("context", F.lit(True).alias("frequent"))
    marked = runs.withColumn("context", context).join(F.broadcast(most), "context", "left").select(
        "run", "n", F.coalesce("frequent", F.lit(False)).cast("int").alias("frequent"))

    def make():
        levels, above = top.value

        def compute(run, n, frequent):
            chosen = np.unique(run[frequent > 0] >> 8)
            rows = np.zeros((0, 0), np.float32)
            if len(chosen):
                model = Model(_levels(run, n, levels), above)
                rows = model.table[model.first[DEPTH] + np.searchsorted(model.contexts[DEPTH], chosen)]
            return {"context": pa.array(chosen), "chances": pa.array([row.tobytes() for row in rows], pa.binary())}

        return compute

    found = _by_subtree(marked, make, "context long, chances binary").toPandas().sort_values("context")
    contexts = [found["context"].to_numpy(np.int64)]
    for depth in range(DEPTH - 1, -1, -1):
        contexts.insert(0, np.unique(contexts[0] & ((1 << 8 * depth) - 1)))
    symbols = np.append(top.value[0][0][1], -1)
    table = np.frombuffer(b"".join(found["chances"]), np.float32).reshape(len(found), len(symbols))
    return contexts, symbols, table


def _chances(runs: DataFrame, asked: DataFrame, top) -> DataFrame:
    """(run, chance): log10 probability of the last byte of each run asked for, seen in training or not."""
    rows = runs.select("run", "n").unionByName(asked.select("run", F.lit(0).cast("long").alias("n")))

    def make():
        levels, above = top.value

        def compute(run, n):
            seen, wanted = n > 0, run[n == 0]
            chances = np.zeros(0)
            if len(wanted):
                chances = Scorer(*Model(_levels(run[seen], n[seen], levels), above).state()).of_runs(wanted)
            return {"run": pa.array(wanted), "chance": pa.array(chances)}

        return compute

    return _by_subtree(rows, make, "run long, chance double")


_AT_ONCE = 1 << 18
_RUNS_AT_ONCE = 1 << 17


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the words of the texts, A-Z lowered; words are runs of what is no ASCII space."""
    def run(batches):
        counts = Counter()
        for batch in pieces(batches, "text"):
            for data in values_of(batch, "text"):
                counts.update(data.lower().split())
                if len(counts) > 300_000:
                    yield made(counts)
                    counts = Counter()
        if counts:
            yield made(counts)

    def made(counts):
        words = pa.array(list(counts.keys()), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every
    document, learned from those outside the held-out fold.

    A null text is an empty one: its only token, and its only byte to predict, is the end. A null id
    is in no fold and not learned from. With no training text all words are unknown and each byte
    has the same chance. Repeated rows are scored alike.
    """
    docs = docs.select("doc_id", "text")
    training = docs.where(fold("doc_id", FOLDS) != HELD_OUT)
    words = written(word_counts(training), "words")
    runs = written(count_runs(training), "runs")
    spark = docs.sparkSession
    top = spark.sparkContext.broadcast(_top(runs))
    row = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = training.count()
    total, distinct = row[1] + ends, row[0] + (1 if ends else 0)
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    most = words.orderBy(F.desc("c"), "word").limit(FREQUENT)
    frequent = {r["word"].encode(): r["c"] for r in most.collect()}
    least = min(frequent.values(), default=0)
    state = _frequent_state(runs, top) if len(top.value[0][0][0]) else None
    shared = spark.sparkContext.broadcast((frequent, state))
    fields = [StructField("n_tokens", LongType()), StructField("known", LongType()), StructField("base", DoubleType()),
              StructField("model", DoubleType()), StructField("size", LongType()),
              StructField("rare", ArrayType(StringType())), StructField("times", ArrayType(LongType())),
              StructField("runs", ArrayType(LongType())), StructField("run_times", ArrayType(LongType()))]

    def make():
        counts, tables = shared.value
        logs = {word: np.log10(c + 0.5) for word, c in counts.items()}
        scorer = tables and Scorer(*tables, whole=False)
        nothing, end = float(np.log10(0.5)), float(np.log10(ends + 0.5))

        def compute(texts):
            out = [[] for _ in fields]
            if scorer:
                found_runs = scorer.score_known(texts)
            else:
                found_runs = [-8 * _LOG10_2 * (len(t) + 1) for t in texts], [[]] * len(texts), [[]] * len(texts)
            for data, m, codes, code_times in zip(texts, *found_runs, strict=True):
                own = data.lower().split()
                found = [logs[w] for w in own if w in logs]
                rare = Counter([w for w in own if w not in logs])
                n = len(own) + 1
                base = sum(found) + end + nothing * (len(own) - len(found)) - n * norm
                values = (n, len(found) + (1 if ends else 0), base, m, len(data) + 1,
                          [w.decode("utf-8", "replace") for w in rare], list(rare.values()), codes, code_times)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            return out

        return compute

    scored = append_columns(docs, ["text"], fields, make).drop("text")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select(
        "row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    known = pairs.join(words.where(F.col("c") <= least), "word")
    # Words that don't join are unknown, and the base holds all rare words as such.
    more = known.select(
        "row", F.col("times").alias("more_known"),
        (F.col("times") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("more"), F.lit(None).cast("double").alias("more_model"))
    if state:
        left = scored.select("row", F.explode(F.arrays_zip("runs", "run_times")).alias("p")).select(
            "row", F.col("p.runs").alias("run"), F.col("p.run_times").alias("times"))
        chances = _chances(runs, left.select("run").distinct(), top)
        more = more.unionByName(left.join(chances, "run").select(
            "row", F.lit(None).cast("long").alias("more_known"), F.lit(None).cast("double").alias("more"),
            (F.col("times") * F.col("chance")).alias("more_model")))
    more = more.groupBy("row").agg(*[F.sum(name).alias(name) for name in ("more_known", "more", "more_model")])
    joined = scored.drop("rare", "times", "runs", "run_times").join(more, "row", "left").withColumn(
        "model", F.col("model") + F.coalesce("more_model", F.lit(0.0)))
    return joined.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        F.col("model").alias("score"),
        (-F.col("model") / _LOG10_2 / F.col("size")).alias("bits_per_byte"),
    )
