"""Language identification by compression.

Each language has zstandard raw-content dictionaries made of training texts. A text is
compressed with every language's dictionary and takes the language of the smallest
result. Long texts are cut into blocks, so that the dictionary and not the text's own
beginning explains most of each block, and the sizes are summed. A text whose margin
over the second language is narrow is compressed again with further dictionaries; one
that stays narrow is marked as rejected and keeps its best guess.

Every language with a training text has dictionaries. Their number decides only in how
many passes a task goes over its texts: LANGUAGES_PER_PASS at a time are in memory, and of
each pass the two smallest results stay.
"""

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from statledger.llm.tables import append_columns, fold

FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"
LANGUAGES_PER_PASS = 200
DOCS_PER_LANGUAGE = 400
LOTS = 1_000_000_007
DICTIONARY_BYTES = 48_000
DICTIONARIES = 3
BLOCK = 2048
NARROW = 0.02
_SEARCH = {"window_log": 17, "chain_log": 15, "hash_log": 15, "search_log": 3, "min_match": 4, "target_length": 16,
           "strategy": zstandard.STRATEGY_LAZY2, "write_content_size": False, "write_checksum": False,
           "write_dict_id": False}
_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, per_pass: int = LANGUAGES_PER_PASS):
    """Yields dictionary contents by language, for `per_pass` languages at a time in the order of their names.

    They come of bounded samples outside the held-out fold: of a language, the `per_language` distinct texts
    with the lowest hash of id and text. Each gives a slice from a place drawn over its whole length; the
    slices are as long as together they fill the dictionaries.
    """
    draw = F.xxhash64("doc_id", "text")
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    own = own.select("lang", "text", draw.alias("draw"), F.pmod(draw, F.lit(LOTS)).alias("lot"))
    # Distinct draws, so that a row that is repeated a million times takes no more room than another.
    counts = own.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).orderBy("lang").collect()
    for at in range(0, len(counts), per_pass):
        contents = _contents(own, {row["lang"]: row["n"] for row in counts[at:at + per_pass]}, per_language)
        yield {name: c for name, c in contents.items() if any(c)}


def _contents(own: DataFrame, counts: dict, per_language: int) -> dict:
    # The lots are even, so a language's lowest `per_language` lie below this share of them; what a task
    # ranks doesn't grow with the input.
    ceilings = [F.lit(v) for name, n in counts.items() for v in (name, 2 * per_language * LOTS // max(1, n))]
    below = F.coalesce(F.col("lot") <= F.element_at(F.create_map(*ceilings), F.col("lang")), F.lit(False))
    low = own.where(below).select("lang", "lot", "draw").distinct()
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("lot", "draw")))
    chosen = F.broadcast(ranked.where(F.col("rank") <= per_language).select("lang", "draw"))
    rows = own.where(below).join(chosen, ["lang", "draw"], "left_semi")
    size = F.octet_length("text")
    sizes = rows.select("lang", "draw", size.alias("size")).distinct().orderBy("lang", "draw").collect()
    shares = {name: _share([r["size"] for r in sizes if r["lang"] == name]) for name in counts}
    # Only the slices leave the tasks: characters enough for the share, wherever in the text they lie.
    share = F.element_at(F.create_map(*[F.lit(v) for pair in shares.items() for v in pair]), F.col("lang"))
    places = F.greatest(F.length("text") - share, F.lit(0)) + 1
    first = (F.pmod(F.xxhash64("draw"), places.cast("long")) + 1).cast("int")
    slices = rows.select("lang", "draw", F.substring(F.col("text"), first, share).alias("slice"), share.alias("share")).distinct()
    parts = {name: [[] for _ in range(DICTIONARIES)] for name in counts}
    turn = dict.fromkeys(counts, 0)
    for row in slices.orderBy("lang", "draw", "slice").toLocalIterator():
        parts[row["lang"]][turn[row["lang"]] % DICTIONARIES].append(row["slice"].encode()[:row["share"]])
        turn[row["lang"]] += 1
    return {name: [b"\n".join(part) for part in own_parts if part] for name, own_parts in parts.items()}


def _share(sizes: list) -> int:
    """The longest slice such that texts of these sizes, each cut to it, fill the dictionaries at most."""
    left, share = DICTIONARIES * DICTIONARY_BYTES, 0
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            break
        left -= size
    return max(1, share)


class _Languages:
    def __init__(self, contents: dict):
        self.names = sorted(contents)
        self.layers = []
        for k in range(DICTIONARIES):
            layer = []
            for name in self.names:
                own = contents[name]
                held = zstandard.ZstdCompressionDict(own[k % len(own)], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                search = zstandard.ZstdCompressionParameters(**_SEARCH)
                held.precompute_compress(compression_params=search)
                layer.append(zstandard.ZstdCompressor(compression_params=search, dict_data=held))
            self.layers.append(layer)

    def steps(self, data: bytes):
        """After each layer, the two smallest (size, language): sizes summed over the layers so far."""
        blocks = [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)]
        total = [0] * len(self.names)
        for layer in self.layers:
            total = [size + sum(len(c.compress(block)) for block in blocks) for size, c in zip(total, layer, strict=True)]
            yield sorted(zip(total, self.names, strict=True))[:2]


def _margin(two: list) -> float:
    return (two[1][0] - two[0][0]) / two[1][0] if len(two) > 1 else 1.0


def judge(steps) -> tuple:
    """(language, score, rejected) of the two smallest results after each layer: of the first layer with a
    margin that isn't narrow, or of the last. The score is the winner's distance from the second, 0.5 for a
    tie; a tie goes to the first name."""
    two, margin = [], 0.0
    for two in steps:
        margin = _margin(two)
        if margin >= NARROW:
            break
    return two[0][1], min(1.0, 0.5 + margin * 5), margin < NARROW


def identify(docs: DataFrame, passes: list) -> DataFrame:
    """docs with lang_pred, score and rejected. Null texts and texts without a letter get `und`
    with score 0, as all texts do when no language could be learned.

    passes are the contents that learn() yields.
    """
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    shared = [docs.sparkSession.sparkContext.broadcast(contents) for contents in passes if contents]

    def make():
        only = _Languages(shared[0].value) if len(shared) == 1 else None

        def compute(texts):
            found = [(UNDETERMINED, 0.0, True)] * len(texts)
            own = [k for k, data in enumerate(texts) if shared and _LETTER.search(data.decode("utf-8", "replace"))]
            if only:
                for k in own:
                    found[k] = judge(only.steps(texts[k].lower()))
                return list(zip(*found, strict=True)) or [[], [], []]
            # Of each text the two smallest results of all passes, after each layer.
            held = {k: [[] for _ in range(DICTIONARIES)] for k in own}
            for contents in shared:
                languages = _Languages(contents.value)
                for k in own:
                    for layer, two in enumerate(languages.steps(texts[k].lower())):
                        held[k][layer] = sorted(held[k][layer] + two)[:2]
            for k in own:
                found[k] = judge(held[k])
            return list(zip(*found, strict=True)) or [[], [], []]

        return compute

    return append_columns(docs, ["text"], fields, make)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document; repeated rows are judged alike."""
    passes = list(learn(docs.select("doc_id", "text", "lang")))
    return identify(docs.select("doc_id", "text"), passes).drop("text")
