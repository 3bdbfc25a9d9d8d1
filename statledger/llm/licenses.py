"""License scans by a positional index of rare words, in DataFrame functions only.

How many documents have each word of the license templates is counted over the whole table. The
index holds each template's rarest words with their positions. A file looks up its own highest-IDF
license words; each of their places proposes, for every posting of the word, where the template
would begin, and the places that propose the same beginning are added up by rarity. A template is
found if a beginning has a large enough share of its postings and its key phrases stand in the
text. Base phrases are looked for word by word and always count.

Templates are a table, of any number and length; text is read twice, and only a few places a file
leave that pass.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statledger.llm.tables import lower_ascii
from statledger.session import written

# Base phrases, and the wording of notices with the phrases they must have.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "agpl-3": ("under the terms of the gnu affero general public license version 3", ["gnu affero general public license"]),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    "gpl": ("this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
}
ANCHORS = 6
# So many of a file's license words are looked up, the rarest first.
LOOKED_UP = 24
LEAST_SHARE = 0.6
# The two characters beyond ASCII whose small letter is, or holds, one of a to z.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ODD_CAPITALS = "\u0130", "\u212a"


def templates(spark: SparkSession) -> DataFrame:
    """The built-in templates: label, notice (its words, spaced) and phrases that must stand in the text."""
    rows = [(label, notice, phrases) for label, (notice, phrases) in TEMPLATES.items()]
    return spark.createDataFrame(rows, "label string, notice string, phrases array<string>")


def _words(text: Column) -> Column:
    """The text's words, A-Z lowered, as far as words of ASCII letters are concerned; an empty word stands
    before and behind them where the text doesn't begin or end with one.

    Spark's lower() is much faster than a translation. It lowers letters beyond ASCII too, which no license
    word holds and which stay beyond ASCII, so words end where they did; two odd letters excepted.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit(_ODD_CAPITALS[0])) | F.contains(text, F.lit(_ODD_CAPITALS[1]))
    folded = F.when(odd, lower_ascii(text)).otherwise(F.lower(text))
    # A split is linear in the text; extracting all matches copies the text for each of them.
    return F.split(folded, _BETWEEN)


def rarity(docs: DataFrame, vocabulary: list, text: str = "text") -> tuple:
    """(documents, {word: documents that have it}) over the whole table, for the words of the vocabulary."""
    own = F.array_intersect(F.lit(vocabulary), _words(F.col(text)))
    # One row for each word of the templates comes back, and one with the number of documents.
    words = docs.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word"))
    counts = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}
    return counts.pop("", 0), counts


def index_of(table: DataFrame, docs: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """The postings: label, word, position, weight and share of each template's rarest words.

    A word's weight is the log of all documents to those that have it; its share is its weight's part of
    its template's postings. Of equally rare words the first in the template come first.
    """
    spark = docs.sparkSession
    spots = table.select("label", F.posexplode(F.split("notice", " ")).alias("position", "word"))
    spots = spots.groupBy("label", "word").agg(F.min("position").alias("position"))
    # The templates' words are a parameter, not a matter of the documents.
    vocabulary = sorted(r["word"] for r in spots.select("word").distinct().collect())
    total, counts = rarity(docs, vocabulary)
    counted = spark.createDataFrame([(word, counts.get(word, 0)) for word in vocabulary], "word string, n long")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("n", "position"))
    chosen = spots.join(counted, "word").withColumn("rank", rank).where(F.col("rank") <= anchors)
    weighed = chosen.withColumn("weight", F.log((F.lit(total) + 1.0) / (F.col("n") + 1)) + 1e-3)
    whole = F.sum("weight").over(Window.partitionBy("label"))
    return weighed.withColumn("share", F.col("weight") / whole).select("label", "word", "position", "weight", "share")


def _starts(phrase: str) -> Column:
    """Places, from 0, where the phrase's words stand in the column `words`."""
    parts = phrase.split()
    last = F.size("words") - len(parts)
    return F.filter(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, len(parts)) == F.lit(parts))


def scan(docs: DataFrame, index: list, phrases: list) -> DataFrame:
    """Of each row a number `row`, doc_id, n_words, the places and labels of base phrases, those of the phrases
    that stand in it, and `spots`: (word, place) of its highest-IDF license words. No text.

    index: the words of the postings, the rarest first.
    """
    base_words = sorted({w for phrase in PHRASES for w in phrase.split()})
    none = F.array().cast("array<struct<word:string,place:int>>")
    rows = docs.select("doc_id", _words(F.col("text")).alias("pieces"))
    before, behind = (F.when(F.element_at("pieces", at) == "", 1).otherwise(0) for at in (1, -1))
    count = F.greatest(F.size("pieces") - before - behind, F.lit(0))
    rows = rows.select("doc_id", F.slice("pieces", before + 1, count).alias("words"))
    rows = rows.withColumn("own", F.array_intersect(F.lit([*index, *(w for w in base_words if w not in index)]), "words"))
    looked = F.slice(F.array_intersect(F.lit(index), "own"), 1, LOOKED_UP) if index else F.array().cast("array<string>")
    possible = {phrase: F.size(F.array_except(F.lit(phrase.split()), "own")) == 0 for phrase in PHRASES}
    rows = rows.select("*", looked.alias("looked"), *[possible[p].alias(f"may{k}") for k, p in enumerate(PHRASES)])
    listed = F.transform("words", lambda word, place: F.struct(word.alias("word"), place.alias("place")))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    telling = F.size("looked") > 0
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
        *[F.when(F.col(f"may{k}"), _starts(p)).otherwise(F.array().cast("array<int>")).alias(f"base{k}") for k, p in enumerate(PHRASES)],
        F.when(telling, F.filter(listed, lambda spot: F.array_contains("looked", spot["word"]))).otherwise(none).alias("spots"),
        F.when(telling, joined).alias("joined"),
    )
    stand = F.filter(F.lit(phrases), lambda p: F.contains("joined", F.concat(F.lit(" "), p, F.lit(" "))))
    labels = [F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]
    found = rows.select(
        "row", "doc_id", "n_words", "spots",
        F.concat(*[F.col(f"base{k}") for k in range(len(PHRASES))]).alias("base_starts"),
        F.array_compact(F.array(*labels)).alias("base_found"),
        F.when(F.col("joined").isNotNull(), stand).otherwise(F.array().cast("array<string>")).alias("phrases"),
    )
    return written(found, "licenses")


def matches(scanned: DataFrame, index: DataFrame, table: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """row, label, place and share of every template found: places are of the words at which it begins."""
    spots = scanned.where(F.size("spots") > 0).select("row", "phrases", F.inline("spots"))
    proposed = spots.join(index, "word").groupBy("row", "label", (F.col("place") - F.col("position")).alias("begin")).agg(
        F.round(F.sum("share"), 6).alias("share"), F.any_value("phrases").alias("stand")).where(F.col("share") >= least)
    checked = proposed.join(table.select("label", "phrases"), "label")
    return checked.where(F.size(F.array_except("phrases", "stand")) == 0).select("row", "label", F.col("begin").alias("place"), "share")


def find(docs: DataFrame, table: DataFrame = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    The score is 1 with a base label, else the best template's share, 0 without any. Null and empty
    texts have no words and no labels; repeated rows get the same ones; an empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    table = templates(docs.sparkSession) if table is None else table
    index = written(index_of(table, docs), "postings")
    words = [r["word"] for r in index.groupBy("word").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "word").collect()]
    phrases = [r["phrase"] for r in table.select(F.explode("phrases").alias("phrase")).distinct().orderBy("phrase").collect()]
    scanned = scan(docs, words, phrases)
    own = matches(scanned, index, table).groupBy("row").agg(
        F.collect_set("label").alias("own"), F.max("share").alias("share"))
    name = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return scanned.join(own, "row", "left").select(
        "doc_id", "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").cast("long").alias("first_word"),
        F.array_max("base_starts").cast("long").alias("last_word"),
        name(F.col("base_found")).alias("base_labels"),
        name(F.concat("base_found", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base_found") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
