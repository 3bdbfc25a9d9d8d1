"""Packing documents into as few sequences of bounded length as it can: large items matched first.

A document is its token ids and one separator; a longer one than a sequence is cut into pieces.
Lengths are small whole numbers, so the whole table is a count of each length, and the packing is
planned on those counts: pieces above a third of the capacity stand at most two in a sequence and
are matched greedily, the longest with the longest that fits it, which leaves the fewest sequences
that hold them; shorter pieces then go, longest first, where they leave the least room (best fit),
and open a sequence only where none has room. The plan is a list of steps "the next pieces of this
length, so many a sequence, go into these sequences": of the size of the lengths, not of the table.

Pieces are numbered among those of their length: by their place in the task that cut them, plus
the counts of the tasks before it. No row of one length, however common, meets in one task.
"""

from bisect import bisect_right, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from statledger.llm.tables import pieces as text_pieces
from statledger.llm.tables import values_of
from statledger.llm.vocabulary import WordIds, tokenizer, word_end_encoder
from statledger.session import written

CAPACITY = 2048
SEPARATOR = 0

_PIECE = [
    StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
    StructField("ids_crc32", LongType()), StructField("ids", BinaryType()),
    StructField("lot", IntegerType()), StructField("place", LongType()),
]
# A step's rows are found by length and first number in one whole number; tables have fewer rows than that.
_LENGTH_BITS = 40


def plan(counts: dict, capacity: int = CAPACITY) -> list:
    """Steps (length, first, count, each, sequence, offset) that pack counts[length] pieces of each length.

    The pieces of a length numbered first to first + count - 1 go, `each` a sequence, into the
    sequences from `sequence` on, the first of each at `offset`, the others behind it.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    left, used, steps = dict(counts), dict.fromkeys(counts, 0), []
    rooms = [[] for _ in range(capacity + 1)]
    opened = 0

    def put(length, sequences, each, sequence, offset):
        steps.append((length, used[length], sequences * each, each, sequence, offset))
        used[length] += sequences * each
        left[length] -= sequences * each

    def open_with(parts, sequences):
        """So many new sequences, each with (length, copies) of the parts."""
        nonlocal opened
        offset = 0
        for length, each in parts:
            put(length, sequences, each, opened, offset)
            offset += length * each
        rooms[capacity - offset].append((opened, sequences))
        opened += sequences

    large = sorted((x for x in counts if 3 * x > capacity and left[x]), reverse=True)
    halves = sorted(x for x in large if 2 * x <= capacity)
    for length in large:
        while 2 * length > capacity and left[length]:
            at = bisect_right(halves, capacity - length) - 1
            if at < 0:
                open_with([(length, 1)], left[length])
                break
            partner = halves[at]
            open_with([(length, 1), (partner, 1)], min(left[length], left[partner]))
            if not left[partner]:
                halves.pop(at)
    # Any two of those up to half the capacity fit: with their like first, the odd one with the next.
    while halves:
        length = halves.pop()
        if left[length] > 1:
            open_with([(length, 2)], left[length] // 2)
        if left[length] and halves:
            open_with([(length, 1), (halves[-1], 1)], 1)
            if not left[halves[-1]]:
                halves.pop()
        elif left[length]:
            open_with([(length, 1)], 1)

    open_rooms = [room for room in range(1, capacity + 1) if rooms[room]]
    for length in sorted((x for x in counts if 3 * x <= capacity and left[x]), reverse=True):
        while left[length]:
            at = bisect_right(open_rooms, length - 1)
            if at == len(open_rooms):
                fresh = max(1, left[length] // (capacity // length))
                _settle(rooms, open_rooms, capacity, [(opened, fresh)])
                opened += fresh
                continue
            room = open_rooms[at]
            sequence, sequences = rooms[room].pop()
            if not rooms[room]:
                open_rooms.pop(at)
            # Best fit puts the next piece of the length where the last one went, while it has room.
            each = min(room // length, left[length])
            filled = min(sequences, left[length] // each)
            put(length, filled, each, sequence, capacity - room)
            _settle(rooms, open_rooms, room - each * length, [(sequence, filled)])
            if sequences > filled:
                _settle(rooms, open_rooms, room, [(sequence + filled, sequences - filled)])
    return steps


def _settle(rooms, open_rooms, room, sequences):
    if room and not rooms[room]:
        insort(open_rooms, room)
    rooms[room] += sequences


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, ids (null unless kept),
    lot and place: the task and the piece's number among those of its length there.

    A null text is empty; an empty text is one piece of the separator alone. Repeated rows are
    documents of their own.
    """
    schema = StructType([docs.schema["doc_id"], *_PIECE])
    types = [to_arrow_type(f.dataType) for f in _PIECE]

    def run(batches):
        encode = word_end_encoder(tokenizer(vocabulary, special_as_text=False))
        words = WordIds(lambda new: encode([word.decode(errors="replace") for word in new]))
        lot = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in text_pieces(batches, "text"):
            texts = [_words(text) for text in values_of(batch, "text")]
            words.learn(texts)
            rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
            for k, text in enumerate(texts):
                ids = words.of(text) + SEPARATOR.to_bytes(4, "little")
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    rows.append(k)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(own) // 4)
                    sums.append(crc32(own))
                    kept.append(own if keep_ids else None)
            if not rows:
                continue
            places = _places(np.array(lengths), seen)
            arrays = [pa.array(v, t) for v, t in zip(
                (numbers, starts, lengths, sums, kept, [lot] * len(rows), places), types, strict=True)]
            yield pa.RecordBatch.from_arrays([pc.take(batch.column("doc_id"), pa.array(rows)), *arrays], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _words(text: bytes) -> list:
    """The text's words between ASCII spaces, which no token holds or depends on. A-Z are lowered here,
    as the vocabulary lowers them, but where they may spell a special token."""
    return (text if b"<|" in text else text.lower()).split()


def _places(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each length among its like, going on from `seen`, which moves on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(first, len(ordered)))
    places = np.empty(len(lengths), np.int64)
    places[order] = np.arange(len(ordered)) - np.repeat(first, sizes) + seen[ordered]
    seen[ordered[first]] += sizes
    return places


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset, without lot and place.

    pieces must be settled rows (a written table), with a place from 0 without gaps in each lot and length.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("lot", "length").agg(F.count("*").alias("n"))
    # One row a lot and length: `capacity` rows at most come of a task's whole input.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    firsts = written(counts.select("lot", "length", "n", F.coalesce(before, F.lit(0)).alias("first")), "firsts")
    totals = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = sorted(plan(totals, capacity))
    # At most some tens of steps a length, whatever the size of the table.
    shared = spark.sparkContext.broadcast(np.array(steps, np.int64).reshape(-1, 6).T)
    numbered = pieces.join(firsts.drop("n"), ["lot", "length"]).withColumn("number", F.col("first") + F.col("place"))
    out = [f for f in pieces.schema if f.name not in ("lot", "place")]
    added = [StructField("sequence_id", LongType()), StructField("offset", LongType())]

    def run(batches):
        length, first, _, each, sequence, offset = shared.value
        keys = (length << _LENGTH_BITS) + first
        for batch in batches:
            own, number = (batch.column(name).to_numpy() for name in ("length", "number"))
            step = np.searchsorted(keys, (own << _LENGTH_BITS) + number, side="right") - 1
            turn = number - first[step]
            found = [pa.array(sequence[step] + turn // each[step]), pa.array(offset[step] + turn % each[step] * own)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in out] + found, [f.name for f in out + added])

    return numbered.mapInArrow(run, StructType(out + added))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id and offset of every piece of every document.

    An empty table has no pieces. Equal lengths are dealt in the order of the tasks' inputs; which of
    two equal pieces goes where doesn't change any sequence's lengths.
    """
    return place(written(cut(docs, vocabulary, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (little-endian, 4 bytes each), and the documents in them.

    Of a table packed with keep_ids. A sequence holds at most `capacity` pieces.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    whole = F.aggregate("rows", F.lit(b""), lambda held, row: F.concat(held, row["ids"]))
    return joined.select(
        "sequence_id", whole.alias("ids"), F.transform("rows", lambda row: row.dropFields("ids")).alias("documents"))
