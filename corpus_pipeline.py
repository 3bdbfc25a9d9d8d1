"""A corpus from raw documents: five stages, each over what the one before it kept."""

from statledger.llm import decontaminate, mixing, pii, simhash, toxicity
from statledger.llm.tables import load
from statledger.session import written


def without_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model, trained on this table's labels, rejects go."""
    return toxicity.remove(docs, load(spark, sf_dir, "labels"))


def without_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents contaminated with benchmark passages go."""
    return decontaminate.remove(docs, load(spark, sf_dir, "benchmark"))


def without_private_data(spark, docs, sf_dir):
    """Personal data in the texts is replaced by surrogates."""
    replaced, count = pii.replace(docs)
    return replaced.select(*docs.columns)


def mixed(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_private_data),
    ("mixing", mixed),
]

# Trained models and keyed draws are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
