"""A training corpus from ``documents`` in five stages, each a table that the next one reads.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
documents, extra ones included whatever their names; the last returns token
pieces with their places in sequences.

Edge cases: a null or empty text isn't toxic and loses no words; texts without
words are copies of one another, of which one stays, and which no mix takes; a
null doc_id passes through, comes after all others among copies and is never
labelled; repeated rows are copies; a null source is one source, last in order;
an empty table stays empty through all stages; texts are never cut but in the
last stage, into pieces of a sequence's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import mixing, near, packing, substring, toxicity
from docweave.llm.common import discard, read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    return toxicity.not_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Near copies share 0.8 or more of their five-word shingles (Jaccard). Those
    with close SimHash fingerprints come from the grids of ``simhash`` alone, but
    most near copies differ in more bits than grids can carry; so rare shingles
    propose those, and the shingles of every pair are compared.
    """
    return near.one_of_each(docs, words=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur more than once."""
    cut = substring.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences."""
    return packing.pack(packing.to_pieces(docs, packing.tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learnt score, the fingerprints' hash, the tilt or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
