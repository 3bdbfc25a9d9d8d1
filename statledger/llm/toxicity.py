"""Toxicity by a bidirectional GRU with attention pooling over overlapping windows.

A word enters as the sum of what two inputs give: a learned word vector (words of the
training texts; others share one) and the learned vectors of its runs of four
characters. Two gated recurrent nets read each window forwards and backwards, attention
pools their states, and a logistic unit scores the window. Training is plain numpy on
the driver, over a bounded sample of the labelled documents: at most TRAIN_DOCS
documents drawn by hash, of each TRAIN_PER_DOC windows drawn over its whole text, and
TRAIN_WINDOWS windows in all; a fifth of the documents only tells when to stop and, read
whole, how to set the scale. Scoring reads every window of every
whole text; a document's score is its highest window's, set on the scale of a
probability by a logistic fit.
"""

import re
from zlib import crc32 as _crc

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField

from statledger.llm.tables import append_columns, fold, free_name
from statledger.session import written

WINDOW = 12
TRAIN_DOCS = 5000
TRAIN_WINDOWS = 24_000
TRAIN_PER_DOC = 16
VOCABULARY = 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GRAMS, _SIZE, _HIDDEN = 1 << 14, 8, 8
_AT_ONCE = 1 << 16
# Products have one shape each, so that a window's score doesn't depend on what is scored with it.
_LOT, _NEW = 2048, 1024
_CACHE = 3 * _AT_ONCE
_PAD, _OTHER = 0, 1
_REACH = 5.0


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _grams(word: bytes) -> list:
    marked = b"<" + word + b">"
    return [_crc(marked[i:i + 4]) % _GRAMS for i in range(max(1, len(marked) - 3))]


class Net:
    """Weights, forward pass and gradients. Words are rows of a table of input vectors."""

    def __init__(self, vocabulary: dict, odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, d = _HIDDEN, _SIZE
        draw = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        self.vocabulary = vocabulary
        words = draw(len(vocabulary) + 2, d, scale=0.05)
        words[:, 0] += odds
        grams = draw(_GRAMS, d, scale=0.05)
        grams[:, 1] += gram_odds
        self.w = {
            "words": words, "grams": grams,
            "in": draw(d, 6 * h), "bias": np.zeros(6 * h, np.float32),
            "up": draw(h, 3 * h), "down": draw(h, 3 * h),
            "att": draw(2 * h, h), "att_v": draw(h), "out": draw(2 * h), "out_b": np.zeros(1, np.float32),
        }

    @classmethod
    def of(cls, vocabulary: dict, weights: dict):
        net = cls.__new__(cls)
        net.vocabulary, net.w = vocabulary, weights
        return net

    def project(self, vectors):
        """Input to both nets' gates of word vectors."""
        return vectors @ self.w["in"] + self.w["bias"]

    def _run(self, gates, u, keep):
        n, steps, h = gates.shape[0], gates.shape[1], _HIDDEN
        state = np.zeros((n, h), np.float32)
        out, trace = np.empty((n, steps, h), np.float32), []
        for t in range(steps):
            g, k = gates[:, t], state @ u
            zr = 1.0 / (1.0 + np.exp(-(g[:, :2 * h] + k[:, :2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h:] + r * k[:, 2 * h:])
            if keep:
                trace.append((state, z, r, c, k[:, 2 * h:]))
            state = c + z * (state - c)
            out[:, t] = state
        return out, trace

    def forward(self, gates, mask, keep=False):
        """Logits of windows from their gates (windows, steps, 6H) and the mask of real words."""
        h3 = 3 * _HIDDEN
        ahead, trace_a = self._run(gates[:, :, :h3], self.w["up"], keep)
        back, trace_b = self._run(gates[:, ::-1, h3:], self.w["down"], keep)
        states = np.concatenate([ahead, back[:, ::-1]], axis=2)
        key = np.tanh(states @ self.w["att"])
        weight = np.where(mask, np.exp(np.clip(key @ self.w["att_v"], -20, 20)), np.float32(0))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        logit = pooled @ self.w["out"] + self.w["out_b"]
        return (logit, (states, key, weight, pooled, trace_a, trace_b)) if keep else logit

    def _back(self, d_out, trace, u):
        h = _HIDDEN
        n, steps = d_out.shape[:2]
        d_gates, d_u, d_state = np.empty((n, steps, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, k = trace[t]
            d = d_out[:, t] + d_state
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (before - c) * z * (1 - z)
            d_r = d_c * k * r * (1 - r)
            d_gates[:, t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_k = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_u += before.T @ d_k
            d_state = d * z + d_k @ u.T
        return d_gates, d_u

    def gradients(self, gates, mask, labels, weights):
        """(gradient by the gates, gradients of the other weights) of the mean log loss."""
        w, h = self.w, _HIDDEN
        logit, (states, key, weight, pooled, trace_a, trace_b) = self.forward(gates, mask, keep=True)
        d_logit = ((_sigmoid(logit) - labels) * weights / weights.sum()).astype(np.float32)
        grads = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_weight = np.einsum("nh,nth->nt", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grads["att_v"] = np.einsum("nt,nth->h", d_score, key)
        d_key = d_score[:, :, None] * w["att_v"] * (1 - key * key)
        grads["att"] = np.einsum("nth,ntk->hk", states, d_key)
        d_states = weight[:, :, None] * d_pooled[:, None] + d_key @ w["att"].T
        d_a, grads["up"] = self._back(d_states[:, :, :h], trace_a, w["up"])
        d_b, grads["down"] = self._back(d_states[:, ::-1, h:], trace_b, w["down"])
        return np.concatenate([d_a, d_b[:, ::-1]], axis=2), grads


class _Words:
    """Rows of word vectors for words; words of the vocabulary first, others as they come."""

    def __init__(self, net: Net):
        self.net = net
        listed = sorted(net.vocabulary, key=net.vocabulary.get)
        self.known = {word: k + 2 for k, word in enumerate(listed)}
        base = net.w["words"].copy()
        base[2:] += self._characters(listed)
        base[_PAD] = 0
        self.base = net.project(base)
        self.reset()

    def reset(self):
        self.ids, self.used = dict(self.known), len(self.base)
        self.table = np.empty((len(self.base) + _CACHE, self.base.shape[1]), np.float32)
        self.table[:self.used] = self.base

    def _characters(self, words):
        if not words:
            return np.empty((0, _SIZE), np.float32)
        lists = list(map(_grams, words))
        lengths = np.array([len(x) for x in lists])
        flat = self.net.w["grams"][np.concatenate(lists)]
        sums = np.add.reduceat(flat, np.append(0, np.cumsum(lengths)[:-1]), axis=0)
        return sums / np.sqrt(lengths[:, None].astype(np.float32))

    def rows(self, words):
        new = list(set(words).difference(self.ids))
        for at in range(0, len(new), _NEW):
            lot = new[at:at + _NEW]
            vectors = np.zeros((_NEW, _SIZE), np.float32)
            vectors[:len(lot)] = self._characters(lot) + self.net.w["words"][_OTHER]
            self.ids.update(zip(lot, range(self.used, self.used + len(lot)), strict=True))
            self.table[self.used:self.used + len(lot)] = self.net.project(vectors)[:len(lot)]
            self.used += len(lot)
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))


def top_logits(net: Net, texts: list, words: _Words) -> np.ndarray:
    """Each text's highest window logit, -inf for a text without words. Equal texts are scored once."""
    distinct = list(dict.fromkeys(texts))
    best = np.full(len(distinct), -np.inf)
    scorer = _Scorer(net)
    parts, owners, held = [], [], 0
    for k, data in enumerate(distinct):
        tokens = _WORD.findall(data.lower())
        # Long texts go in steps; a step begins with the words that its first window shares.
        for at in range(0, len(tokens), _AT_ONCE):
            parts.append(tokens[max(0, at - WINDOW + 1):at + _AT_ONCE])
            owners.append(k)
            held += len(parts[-1])
            if held >= _AT_ONCE:
                _score_parts(scorer, words, parts, owners, best)
                parts, owners, held = [], [], 0
    if parts:
        _score_parts(scorer, words, parts, owners, best)
    place = {data: k for k, data in enumerate(distinct)}
    return best[[place[data] for data in texts]] if texts else best


def _score_parts(scorer, words, parts, owners, best):
    """Raises best[owner] to the highest logit over the windows of each part, a list of words."""
    if len(words.ids) + sum(map(len, parts)) > len(words.known) + _CACHE:
        words.reset()
    rows = words.rows([w for part in parts for w in part])
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    # Parts stand in a row, one shorter than a window padded to it; windows over two parts don't count.
    room = np.maximum(lengths, WINDOW)
    starts = np.cumsum(room) - room
    line = np.full(-(-int(room.sum()) // _LOT) * _LOT + WINDOW, _PAD, np.int32)
    line[np.arange(len(rows)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)] = rows
    logits = np.concatenate([scorer(words.table, line[at:at + _LOT + WINDOW - 1]) for at in range(0, len(line) - WINDOW, _LOT)])
    bounds = np.stack([starts, starts + np.maximum(1, lengths - WINDOW + 1)], axis=1).ravel()
    highest = np.maximum.reduceat(np.append(logits, -np.inf), bounds)[::2]
    np.maximum.at(best, owners, highest)


class _Scorer:
    """Logits of the windows at _LOT places in a row.

    The same net as Net.forward, for speed with windows as columns: at each step the gates of all
    windows are a stretch of the gates of the words, and both gates and candidates come of one
    exponential, 1 / (1 + exp(-x)) and 2 / (1 + exp(-2x)) - 1, whose factors are in the weights.
    """

    def __init__(self, net: Net):
        h, w = _HIDDEN, net.w
        self.factor = np.repeat(np.float32([-1, -1, -2, -1, -1, -2]), h)
        side = self.factor[:3 * h, None]
        self.turns = np.ascontiguousarray(w["up"].T) * side, np.ascontiguousarray(w["down"].T) * side
        # Of each state its part in the attention's key and in the logit.
        heads = np.hstack([-2 * w["att"], w["out"][:, None]])
        self.heads = np.ascontiguousarray(heads[:h].T), np.ascontiguousarray(heads[h:].T)
        self.att_v, self.out_b = w["att_v"], w["out_b"]
        empty = lambda *shape: np.empty((*shape, _LOT), np.float32)
        self.turned, self.zr, self.c, self.state = empty(3 * h), empty(2 * h), empty(h), empty(h)
        self.ahead, self.back, self.key = empty(WINDOW, h + 1), empty(h + 1), empty(h)

    def _steps(self, gates, side):
        """The states' parts at each step, as the steps go."""
        h = _HIDDEN
        turned, zr, c, state = self.turned, self.zr, self.c, self.state
        state[:] = 0
        for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
            own = gates[3 * h * side:3 * h * (side + 1), t:t + _LOT]
            np.matmul(self.turns[side], state, out=turned)
            np.add(turned[:2 * h], own[:2 * h], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[h:], turned[2 * h:], out=c)
            c += own[2 * h:]
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            state -= c
            state *= zr[:h]
            state += c
            yield t, np.matmul(self.heads[side], state, out=self.ahead[t] if side == 0 else self.back)

    def __call__(self, table, rows):
        h = _HIDDEN
        with np.errstate(over="ignore"):
            gates = np.ascontiguousarray((table[rows] * self.factor).T)
            real = (rows != _PAD).astype(np.float32)
            for _ in self._steps(gates, 0):
                pass
            summed, weights = np.zeros(_LOT, np.float32), np.zeros(_LOT, np.float32)
            for t, back in self._steps(gates, 1):
                key = np.add(self.ahead[t, :h], back[:h], out=self.key)
                np.exp(key, out=key)
                key += 1
                np.divide(2, key, out=key)
                key -= 1
                weight = np.exp(np.clip(self.att_v @ key, -20, 20)) * real[t:t + _LOT]
                weights += weight
                weight *= self.ahead[t, h] + back[h]
                summed += weight
        # A window of padding alone belongs to no text.
        return summed / np.maximum(weights, np.float32(1e-30)) + self.out_b


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(draw, mark, text) of at most `most` labelled documents outside the held-out fold, those with
    the lowest hash of their id. A document with several labels is toxic if one says so."""
    marked = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("doc_id"))
    chosen = marked.orderBy("draw", "doc_id").limit(most)
    # At most `most` ids, whatever the size of the tables.
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("chosen_id"), F.col("toxic").alias("mark"), "draw"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("chosen_id"))
    # Repeated rows of an id may hold several texts; the bound is on documents, so one is taken.
    return written(rows.groupBy("doc_id", "draw", "mark").agg(F.min("text").alias("text")).drop("doc_id"), "sample")


def drawn_windows(words: list, draw: int, most: int = TRAIN_PER_DOC) -> list:
    """At most `most` windows of the words: their places are cut into equal parts, and each part
    gives the window at a place drawn by the hash. No words give no window."""
    if not words:
        return []
    places = max(1, len(words) - WINDOW + 1)
    edges = np.linspace(0, places, min(most, places) + 1).astype(np.int64)
    starts = np.random.default_rng(draw & (1 << 63) - 1).integers(edges[:-1], edges[1:])
    return [words[s:s + WINDOW] for s in starts.tolist()]


def training_windows(sample: DataFrame) -> list:
    """(draw, label, windows) of each document of the sample. The tasks cut them, so that what the
    driver gets of a document doesn't grow with its text."""
    def compute(texts, draws):
        return [[[b" ".join(w) for w in drawn_windows(_WORD.findall(data.lower()), draw)]
                 for data, draw in zip(texts, draws, strict=True)]]

    field = StructField("windows", ArrayType(BinaryType()))
    cut = append_columns(sample, ["text", "draw"], [field], lambda: compute).drop("text")
    return [(r["draw"], int(r["mark"]), [bytes(w).split(b" ") for w in r["windows"]])
            for r in cut.orderBy("draw").toLocalIterator()]


def _tops_of(sample: DataFrame, draws: set, net: Net) -> tuple:
    """(highest logits over the whole texts of the sample's documents with these draws, their labels)."""
    shared = sample.sparkSession.sparkContext.broadcast((draws, net.vocabulary, net.w))

    def make():
        own, *state = shared.value
        net = Net.of(*state)
        words = _Words(net)

        def compute(texts, draws):
            some = [k for k, draw in enumerate(draws) if draw in own]
            out = [None] * len(texts)
            for k, top in zip(some, top_logits(net, [texts[k] for k in some], words).tolist(), strict=True):
                out[k] = top
            return [out]

        return compute

    tops = append_columns(sample, ["text", "draw"], [StructField("top", DoubleType())], make)
    rows = tops.where("top is not null").select("draw", "mark", "top").orderBy("draw").collect()
    return np.array([r["top"] for r in rows]), np.array([r["mark"] for r in rows], np.float32)


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> tuple:
    """(net, scale, shift, prior) from the sample of the labelled documents."""
    sample = training_sample(docs, labels)
    rows = training_windows(sample)
    prior = (sum(y for _, y, _ in rows) + 0.5) / (len(rows) + 1)
    rows = [r for r in rows if r[2]]
    y = np.array([label for _, label, _ in rows], np.float32)
    checks = np.arange(len(y)) % 5 == 4
    if min((y == v)[part].sum() for v in (0, 1) for part in (checks, ~checks)) == 0:
        return None, 0.0, 0.0, prior
    fit = [r[2] for r, c in zip(rows, checks, strict=True) if not c]
    net = Net(*_vocabulary([[w for window in windows for w in window] for windows in fit], y[~checks]), seed)
    _fit(net, fit, y[~checks], [r[2] for r, c in zip(rows, checks, strict=True) if c], y[checks], seed)
    # The scale is set on what scoring compares with it, the highest window of the whole text.
    top, marks = _tops_of(sample, {r[0] for r, c in zip(rows, checks, strict=True) if c}, net)
    scale, shift = _fit_logistic(np.clip(top, -_REACH, _REACH), marks)
    return net, scale, shift, prior


def _vocabulary(tokens, y):
    """Words of at least 5 documents, and the odds of words and of runs of characters."""
    seen, runs = {}, np.zeros((_GRAMS, 2))
    for words, label in zip(tokens, y, strict=True):
        words = set(words)
        for word in words:
            seen.setdefault(word, [0, 0])[int(label)] += 1
        runs[list({g for word in words for g in _grams(word)}), int(label)] += 1
    common = sorted((w for w, n in seen.items() if sum(n) >= 5), key=lambda w: (-sum(seen[w]), w))[:VOCABULARY]
    counts = np.array([[0, 0], [0, 0]] + [seen[w] for w in common], float)
    rate = y.mean()
    return {w: k for k, w in enumerate(common)}, _odds(counts, rate), _odds(runs, rate)


def _odds(counts, rate):
    """How far the share of toxic documents, shrunk towards the share of all by 10 documents, lies
    from that share in log odds, halved."""
    p = (counts[:, 1] + 10 * rate) / (counts.sum(axis=1) + 10)
    return 0.5 * (np.log(p / (1 - p)) - np.log(rate / (1 - rate)))


def _window_rows(docs, y, ids):
    sizes = [len(windows) for windows in docs]
    rows = np.zeros((sum(sizes), WINDOW), np.int32)
    for row, words in zip(rows, (words for windows in docs for words in windows), strict=True):
        row[:len(words)] = [ids[w] for w in words]
    return rows, np.repeat(y.astype(np.float32), sizes), np.repeat(np.arange(len(docs)), sizes)


def _fit(net, docs, y, check_docs, check_y, seed):
    """Adam over windows, first each with its document's label, then only those that tell: the
    highest window of each document, and of a clean one the next highest too. The weights of the later
    round with the lowest log loss of the check documents, set on their own scale, stay."""
    rng = np.random.default_rng(seed)
    ids, grams = {}, []
    for word in sorted({w for windows in docs for words in windows for w in words}):
        ids[word] = len(ids) + 1
        grams.append(_grams(word))
    lookup = np.array([_PAD] + [net.vocabulary.get(w, _OTHER - 2) + 2 for w in ids], np.int32)
    offsets = np.append(0, np.cumsum([len(g) for g in grams])).astype(np.int64)
    flat = np.concatenate([np.array(g, np.int32) for g in grams])
    windows, labels, of = _window_rows(docs, y, ids)
    order = rng.permutation(len(windows))[:TRAIN_WINDOWS]
    check_texts = [b" ".join(words) for windows in check_docs for words in windows]
    check_first = np.append(0, np.cumsum([len(windows) for windows in check_docs])[:-1])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    best, best_loss, step, even = None, np.inf, 0, np.ones(96, np.float32)
    rounds = int(np.clip(64_000 // len(order), 2, 12))
    for turn in range(2 * rounds):
        if turn >= rounds:
            order = _telling(net, lookup, offsets, flat, windows, labels, of)
        shuffled = rng.permutation(order)
        for at in range(0, len(shuffled), 96):
            lot = shuffled[at:at + 96]
            words, where = np.unique(windows[lot], return_inverse=True)
            where = where.reshape(windows[lot].shape)
            vectors = net.w["words"][lookup[words]].copy()
            real = words > 0
            spans = [np.arange(offsets[w - 1], offsets[w]) for w in words[real]]
            count = np.array([len(s) for s in spans])
            root = np.sqrt(count[:, None].astype(np.float32))
            used = flat[np.concatenate(spans)]
            starts = np.append(0, np.cumsum(count)[:-1])
            vectors[real] += np.add.reduceat(net.w["grams"][used], starts, axis=0) / root
            vectors[~real] = 0
            gates = net.project(vectors)[where]
            d_gates, grads = net.gradients(gates, windows[lot] > 0, labels[lot], even[:len(lot)])
            summed = np.zeros((len(words), d_gates.shape[2]), np.float32)
            np.add.at(summed, where.ravel(), d_gates.reshape(-1, d_gates.shape[2]))
            summed[~real] = 0
            grads["in"], grads["bias"] = vectors.T @ summed, summed.sum(axis=0)
            d_vectors = summed @ net.w["in"].T
            grads["words"] = np.zeros_like(net.w["words"])
            np.add.at(grads["words"], lookup[words], d_vectors)
            grads["grams"] = np.zeros_like(net.w["grams"])
            np.add.at(grads["grams"], used, np.repeat(d_vectors[real] / root, count, axis=0))
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = 0.003 if name in ("words", "grams") else 0.01
                net.w[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        top = np.maximum.reduceat(top_logits(net, check_texts, _Words(net)), check_first)
        top = np.clip(top, -_REACH, _REACH)
        scale, shift = _fit_logistic(top, check_y)
        p = np.clip(_sigmoid(scale * top + shift), 1e-6, 1 - 1e-6)
        loss = -(check_y * np.log(p) + (1 - check_y) * np.log(1 - p)).mean()
        if loss < best_loss or turn == rounds:
            best, best_loss = {k: v.copy() for k, v in net.w.items()}, loss
    net.w = best


def _telling(net, lookup, offsets, flat, windows, labels, of):
    """Each document's highest window and each clean one's second, TRAIN_WINDOWS at most."""
    words = np.unique(windows)
    vectors = net.w["words"][lookup[words]].copy()
    for k in np.flatnonzero(words > 0):
        own = flat[offsets[words[k] - 1]:offsets[words[k]]]
        vectors[k] += net.w["grams"][own].sum(axis=0) / np.sqrt(np.float32(len(own)))
    vectors[words == 0] = 0
    gates = net.project(vectors)
    logit = np.concatenate([
        net.forward(gates[np.searchsorted(words, windows[k:k + 1024])], windows[k:k + 1024] > 0)
        for k in range(0, len(windows), 1024)
    ])
    order = np.lexsort((-logit, of))
    first = np.append(True, np.diff(of[order]) != 0)
    top = order[first]
    second = order[np.flatnonzero(first[:-1] & ~first[1:]) + 1]
    return np.concatenate([top, second[labels[second] == 0]])[:TRAIN_WINDOWS]


def _fit_logistic(x, y, rounds: int = 200):
    """scale > 0 and shift of the logistic curve through (x, y), by Newton steps with a small penalty."""
    mean, spread = x.mean(), x.std() + 1e-6
    z = (x - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 0.01 * a, (p - y).sum()])
        hess = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum()]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    a = max(a, 1e-3)
    return float(a / spread), float(b - a * mean / spread)


def with_scores(docs: DataFrame, model: tuple, text: str = "text") -> tuple:
    """docs with the toxicity score of each text, 0 to 1, and that column's name.

    A text without words, empty or null scores the share of toxic documents in the
    training sample; so does every text if the sample lacks one of the classes.
    """
    field = StructField(free_name(docs, "toxicity"), DoubleType())
    trained, scale, shift, prior = model
    state = trained and (trained.vocabulary, trained.w)
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def make():
        net = shared.value and Net.of(*shared.value)
        words = net and _Words(net)

        def compute(texts):
            if net is None:
                return [[prior] * len(texts)]
            top = top_logits(net, texts, words)
            scores = _sigmoid(scale * np.clip(top, -_REACH, _REACH) + shift)
            return [np.where(np.isneginf(top), prior, scores).tolist()]

        return compute

    return append_columns(docs, [text], [field], make), field.name


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every document; repeated rows score alike."""
    model = train(docs, labels)
    scored, name = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def remove(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score THRESHOLD or more; all columns stay as they are."""
    scored, name = with_scores(docs, train(docs, labels))
    return scored.where(F.col(name) < THRESHOLD).drop(name)
