"""The training-data pipeline: documents in, packed token sequences out.

Five stages, each one operator of ``cartwheel.llm`` on all that the stage
before it kept. Every stage's rows are written as Parquet to the shared
checkpoint folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartwheel.llm import langid, minhash_dedup, mixing, packing, suffix_dedup
from cartwheel.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, trained on the labelled rows of the stage's input; documents
    whose language cannot be told (no text, no letter) go."""
    return langid.keep_identified(docs, langid.train(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates the smallest id stays.

    Stages link at a similarity of 0.8 (the 85 % of ``THRESHOLD`` binds the op3
    query alone). 10 x 2 sketches miss a pair at 0.80 with probability
    2 * (1 - 0.8**2)**10 = 7e-5, as 8 x 2 do at 0.85."""
    return minhash_dedup.keep_one(docs, words=5, threshold=80, side=10, rows=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages of 200 bytes that occur elsewhere are cut out; the
    documents stay, with what is left of their text."""
    return suffix_dedup.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as its source's target asks."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of the documents in sequences of 1024 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers and byte-level models have no SQL form; the tests compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
