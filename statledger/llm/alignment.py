"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection.

Each tokenization is a rising list of byte offsets at which its tokens end. The shorter list drives:
each of its ends is sought in the longer one by steps that double, from where the one before it was
found, and then by halving. Ends found in both cut the tokens into groups; the ranks at which the
others would stand tell which tokens of the longer list each token of the shorter overlaps.

The lists of all texts of a batch are searched at once: each text's ends are moved behind those of
the text before, so the joined lists rise too, and the driving ends are dealt to lanes that advance
side by side.
"""

import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from statledger.llm.tables import append_columns, pieces
from statledger.llm.vocabulary import (
    byte_level_encoder,
    packed,
    piece_bytes,
    piece_model,
    token_bytes,
    tokenizer,
)
from statledger.session import written

# Neither vocabulary has a token over the place before a single space that follows a non-space and
# comes before a word; U+2581 reads as a space in B.
_CUT = re.compile(r"(?<=[^ ▁]) (?=\S)")
_LANE = 64
_LOT_BYTES = 1 << 19
# A task's words are numbered anew beyond so many words or ids.
_MOST_WORDS, _MOST_IDS = 1 << 18, 1 << 23


def seek(longer: np.ndarray, values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of the first entries of the rising `longer` that are not below the values, by galloping
    from `low`: all entries before low must be below their value."""
    size = len(longer)
    low, high = low.copy(), low.copy()
    open_ = np.flatnonzero(low < size)
    open_ = open_[longer[low[open_]] < values[open_]]
    reach = 1
    while open_.size:
        passed = high[open_] + 1
        low[open_] = passed
        ahead = np.minimum(passed + reach, size)
        high[open_] = ahead
        reach *= 2
        inside = ahead < size
        open_, ahead = open_[inside], ahead[inside]
        open_ = open_[longer[ahead] < values[open_]]
    open_ = np.flatnonzero(low < high)
    while open_.size:
        middle = (low[open_] + high[open_]) >> 1
        below = longer[middle] < values[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def ranks(shorter: np.ndarray, starts: np.ndarray, longer: np.ndarray, origins: np.ndarray) -> np.ndarray:
    """For each entry of `shorter` the place in `longer` of the first entry not below it.

    starts are the places in `shorter` where texts begin, origins those texts' first places in `longer`.
    """
    found = np.empty(len(shorter), np.int64)
    sizes = np.diff(np.append(starts, len(shorter)))
    lanes = -(-sizes // _LANE)
    first = np.repeat(starts, lanes) + _LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    ends = np.minimum(first + _LANE, np.repeat(starts + sizes, lanes))
    at = np.repeat(origins, lanes)
    while first.size:
        at = seek(longer, shorter[first], at)
        found[first] = at
        first = first + 1
        going = first < ends
        first, ends, at = first[going], ends[going], at[going]
    return found


class Aligned:
    """A batch of texts in both tokenizations, and where their tokens end together.

    a_ids, b_ids: the ids of all texts in a row; a_from, b_from: where each text's begin (with the
    end of the last). a_at, b_at: the tokens, by place in these rows, that end together, and
    group_from: where each text's begin among them.
    """

    def __init__(self, a_ids, a_from, b_ids, b_from, a_sizes, b_sizes):
        self.a_ids, self.a_from, self.b_ids, self.b_from = a_ids, a_from, b_ids, b_from
        # Both sides spell the same bytes, so a running sum moves each text behind the one before.
        self.a_end, self.b_end = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
        self._intersect()

    def _intersect(self):
        a_count, b_count = np.diff(self.a_from), np.diff(self.b_from)
        self.a_drives = a_count <= b_count
        self.rank = {}
        common = []
        for drives in (True, False):
            own = np.flatnonzero((self.a_drives == drives) & (a_count > 0))
            sides = [(self.a_end, self.a_from), (self.b_end, self.b_from)]
            (short, short_from), (long, long_from) = sides if drives else sides[::-1]
            places = _runs(short_from[own], short_from[own + 1])
            sizes = short_from[own + 1] - short_from[own]
            found = ranks(short[places], np.cumsum(sizes) - sizes, long, long_from[own])
            met = long[np.minimum(found, len(long) - 1)] == short[places] if len(places) else np.zeros(0, bool)
            self.rank[drives] = places, found, met
            common.append((places[met], found[met]) if drives else (found[met], places[met]))
        a_at, b_at = (np.concatenate(x) for x in zip(*common, strict=True))
        order = np.argsort(a_at, kind="stable")
        self.a_at, self.b_at = a_at[order], b_at[order]
        self.group_from = np.searchsorted(self.a_at, self.a_from)

    def overlaps(self, k: int) -> list:
        """For each token of the text's shorter list the first and last token of the longer that share
        a byte with it, counted within the text."""
        drives = bool(self.a_drives[k])
        short_from, long_from = (self.a_from, self.b_from) if drives else (self.b_from, self.a_from)
        places, found, met = self.rank[drives]
        low, high = np.searchsorted(places, short_from[k:k + 2])
        last = found[low:high] - long_from[k]
        first = np.append(0, last + met[low:high])[:len(last)]
        return list(zip(first.tolist(), last.tolist(), strict=True))


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers from each start to before its end, in a row."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Words:
    """Numbers of words, and the ids of each in one tokenization after the other."""

    def __init__(self, encoders, tables):
        self.encoders, self.tables = encoders, tables
        self._empty()

    def _empty(self):
        self.known, self.spelled = {}, np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64) for _ in self.encoders]
        self.first = [np.zeros(1, np.int64) for _ in self.encoders]

    def learn(self, words) -> None:
        if len(self.known) > _MOST_WORDS or sum(map(len, self.ids)) > _MOST_IDS:
            self._empty()
        new = list(set(words).difference(self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        texts = [b" " + word.encode() for word in new]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        right = np.ones(len(new), bool)
        for side, (encode, table) in enumerate(zip(self.encoders, self.tables, strict=True)):
            values = encode(new)
            ids = np.frombuffer(b"".join(values), "<u4").astype(np.int64)
            ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 4)
            spelled = list(map(table.__getitem__, ids.tolist()))
            lengths = np.append(0, np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled))))
            if (np.diff(lengths[ends], prepend=0) != sizes).any() or b"".join(spelled) != b"".join(texts):
                starts = np.append(0, ends)[:-1]
                right &= [b"".join(spelled[low:high]) == text for low, high, text in zip(starts, ends, texts, strict=True)]
            self.first[side] = np.concatenate([self.first[side], self.first[side][-1] + ends])
            self.ids[side] = np.concatenate([self.ids[side], ids])
        self.spelled = np.append(self.spelled, right)

    def of(self, numbers: np.ndarray, side: int) -> tuple:
        """(ids of the numbered words in a row, how many each has)."""
        starts, ends = self.first[side][numbers], self.first[side][numbers + 1]
        return self.ids[side][_runs(starts, ends)], ends - starts


class Aligner:
    """Both vocabularies, with the words met so far. The first is byte-level BPE, the second BPE pieces."""

    def __init__(self, a_path: str, b_path: str):
        a, b = tokenizer(a_path, special_as_text=True), piece_model(b_path)
        tables = self.a_bytes, self.b_bytes = token_bytes(a), piece_bytes(b)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in tables)
        encode = byte_level_encoder(a)
        self.words = _Words([
            lambda new: encode([" " + word for word in new]),
            lambda new: [packed(ids) for ids in b.encode(new, num_threads=1)],
        ], tables)
        # Names of ids by what stands behind them: a's within a group, a's last, b's within, b's last.
        names = [[f"{k}{mark}".encode() for k in range(len(t))] for t, marks in zip(tables, (",|", ",;"), strict=True) for mark in marks]
        self.offsets = np.cumsum([0] + [len(n) for n in names])
        self.names = [name for each in names for name in each]

    def __call__(self, texts: list) -> Aligned:
        """The texts, as UTF-8 bytes. One that is empty, or that a tokenization doesn't spell, has no tokens."""
        words = [_CUT.split(text.decode(errors="replace")) if text else [] for text in texts]
        self.words.learn(chain.from_iterable(words))
        word_from = np.cumsum([0] + list(map(len, words)))
        numbers = np.fromiter(map(self.words.known.__getitem__, chain.from_iterable(words)), np.int64, word_from[-1])
        (a_ids, a_count), (b_ids, b_count) = (self.words.of(numbers, side) for side in (0, 1))
        a_from, b_from = (np.append(0, np.cumsum(count))[word_from] for count in (a_count, b_count))
        odd = np.append(0, np.cumsum(~self.words.spelled[numbers]))[word_from]
        for k in np.flatnonzero(np.diff(odd)):
            sides = (self.a_bytes, a_ids, a_from), (self.b_bytes, b_ids, b_from)
            if not all(self._spells(table, ids[at[k]:at[k + 1]], texts[k]) for table, ids, at in sides):
                a_ids, a_from = _without(a_ids, a_from, k)
                b_ids, b_from = _without(b_ids, b_from, k)
        return Aligned(a_ids, a_from, b_ids, b_from, self.a_sizes, self.b_sizes)

    @staticmethod
    def _spells(table, ids, text):
        return b"".join(map(table.__getitem__, ids.tolist())) == b" " + text

    def spelled_groups(self, found: Aligned) -> list:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`, ids in order; empty without tokens."""
        a_ends, b_ends = found.a_at + 1, found.b_at + 1
        a, b = found.a_ids + self.offsets[0], found.b_ids + self.offsets[2]
        a[found.a_at] += self.offsets[1] - self.offsets[0]
        b[found.b_at] += self.offsets[3] - self.offsets[2]
        # Each side's tokens stand behind the other side's of the groups before (and, of B, of the same group).
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.repeat(np.append(0, b_ends)[:-1], np.diff(a_ends, prepend=0))] = a
        line[np.arange(len(b)) + np.repeat(a_ends, np.diff(b_ends, prepend=0))] = b
        names, at = list(map(self.names.__getitem__, line.tolist())), found.a_from + found.b_from
        return [b"".join(names[low:high])[:-1] for low, high in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _without(ids, starts, k):
    """Ids and starts without those of text k."""
    low, high = starts[k:k + 2]
    return np.delete(ids, slice(low, high)), np.append(starts[:k + 1], starts[k + 1:] - (high - low))


def _lots(texts: list):
    """The texts in lots of about _LOT_BYTES, longer ones alone."""
    lot, size = [], 0
    for text in texts:
        if lot and size + len(text) > _LOT_BYTES:
            yield lot
            lot, size = [], 0
        lot.append(text)
        size += len(text)
    if lot:
        yield lot


def most_pairs(a_path: str, b_path: str) -> int:
    """How many id pairs can end together over any corpus: one's bytes are the end of the other's.

    This bounds the table of pair counts, which is broadcast, by the vocabularies alone.
    """
    a, b = token_bytes(tokenizer(a_path, special_as_text=True)), piece_bytes(piece_model(b_path))
    ends, same = {}, {}
    for tokens in (a, b):
        for token in tokens:
            ends.setdefault(token, [0, 0])
    for side, tokens in enumerate((a, b)):
        for token in tokens:
            ends[token][side] += 1
    same = sum(x * y for x, y in ends.values())
    suffixes = sum(ends[t[k:]][1 - side] for side, tokens in enumerate((a, b)) for t in tokens
                   for k in range(1, len(t)) if t[k:] in ends)
    return same + suffixes


def _columns(rows: list, width: int) -> list:
    return list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in range(width)]


_TOKENS = [
    StructField("a_ids", ArrayType(IntegerType())), StructField("b_ids", ArrayType(IntegerType())),
    StructField("groups", ArrayType(StructType([StructField("a_end", IntegerType()), StructField("b_end", IntegerType())]))),
    StructField("shorter", StringType()),
    StructField("overlaps", ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))),
]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, groups, shorter and overlaps of every document.

    groups are the tokens, counted in the text, at which both sides end: the group goes from behind the
    one before it up to them. overlaps are, for each token of the side named by shorter, the first and
    last token of the other that share a byte with it. All lists are empty for a text without tokens.
    """
    def make():
        aligner = Aligner(a_path, b_path)

        def rows(texts):
            found = aligner(texts)
            for k in range(len(texts)):
                (a, a_end), (b, b_end), (low, high) = found.a_from[k:k + 2], found.b_from[k:k + 2], found.group_from[k:k + 2]
                groups = zip((found.a_at[low:high] - a).tolist(), (found.b_at[low:high] - b).tolist(), strict=True)
                yield (found.a_ids[a:a_end].tolist(), found.b_ids[b:b_end].tolist(),
                       [{"a_end": x, "b_end": y} for x, y in groups], "a" if found.a_drives[k] else "b",
                       [{"first": x, "last": y} for x, y in found.overlaps(k)])

        def compute(texts):
            return _columns([row for lot in _lots(texts) for row in rows(lot)], len(_TOKENS))

        return compute

    return append_columns(docs.select("doc_id", "text"), ["text"], _TOKENS, make).drop("text")


_COUNTS = [StructField(name, LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")]


class Pairs:
    """Id pairs as single numbers: a id times the ids of B, plus b id, in 4 or 8 bytes."""

    def __init__(self, a_path: str, b_path: str):
        a_ids, self.b_ids = tokenizer(a_path, special_as_text=True).get_vocab_size(), piece_model(b_path).vocab_size()
        self.kind = "<u4" if a_ids * self.b_ids <= 1 << 32 else "<u8"

    def packed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * self.b_ids + b).astype(self.kind)

    def read(self, data: list) -> np.ndarray:
        return np.frombuffer(b"".join(data), self.kind)


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, the counts of tokens, groups and links, groups_sha256, and the links: the Pairs of all
    tokens that end together, in their order."""
    numbers = Pairs(a_path, b_path)
    width = np.dtype(numbers.kind).itemsize
    fields = [*_COUNTS, StructField("groups_sha256", StringType()), StructField("links", BinaryType())]

    def make():
        aligner = Aligner(a_path, b_path)

        def rows(texts):
            found = aligner(texts)
            pairs = numbers.packed(found.a_ids[found.a_at], found.b_ids[found.b_at]).tobytes()
            at = found.group_from.tolist()
            for k, spelled in enumerate(aligner.spelled_groups(found)):
                groups = at[k + 1] - at[k]
                yield (int(found.a_from[k + 1] - found.a_from[k]), int(found.b_from[k + 1] - found.b_from[k]), groups, groups,
                       sha256(spelled).hexdigest() if spelled else "", pairs[width * at[k]:width * at[k + 1]])

        def compute(texts):
            return _columns([row for lot in _lots(texts) for row in rows(lot)], len(fields))

        return compute

    return append_columns(docs.select("doc_id", "text"), ["text"], fields, make).drop("text")


def pair_counts(linked: DataFrame, numbers: Pairs) -> DataFrame:
    """pair, n: how often each pair of ids is linked in the whole table."""
    def run(batches):
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in pieces(batches, "links"):
            new, n = np.unique(numbers.read(batch.column("links").to_pylist()), return_counts=True)
            held, where = np.unique(np.append(held, new.astype(np.int64)), return_inverse=True)
            counts = np.bincount(where, np.append(counts, n), minlength=len(held)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])

    summed = linked.select("links").mapInArrow(run, "pair long, n long")
    return summed.groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    n_best are the links whose pair is as often linked as any of its b id, ties included; count_sum adds
    up how often the pair of each link is linked in the whole table. A null or empty text, and one that a
    tokenization doesn't spell, has zeros and an empty hash. Repeated rows count each time. The texts are
    encoded once: the links are written, counted, and read again.
    """
    linked = written(links(docs, a_path, b_path), "links")
    # At most most_pairs(a, b) rows, some hundred thousand, whatever the size of the table.
    numbers = Pairs(a_path, b_path)
    rows = pair_counts(linked, numbers).toArrow()
    pairs, counts = (rows.column(name).to_numpy().astype(np.int64) for name in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    b = pairs % numbers.b_ids
    highest = np.zeros(numbers.b_ids, np.int64)
    np.maximum.at(highest, b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((pairs.astype(numbers.kind), counts, counts == highest[b]))
    width = np.dtype(numbers.kind).itemsize

    def make():
        pairs, counts, best = shared.value

        def compute(linked):
            starts = np.cumsum([0] + [len(x) // width for x in linked])
            at = np.searchsorted(pairs, numbers.read(linked))
            return [np.diff(np.append(0, np.cumsum(values[at]))[starts]) for values in (best.astype(np.int64), counts)]

        return compute

    fields = [StructField("n_best", LongType()), StructField("count_sum", LongType())]
    return append_columns(linked, ["links"], fields, make).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
