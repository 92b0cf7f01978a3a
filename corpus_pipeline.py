"""The corpus pipeline: five stages over ``documents``, each written and read again.

toxicity -> lines -> near_duplicates -> mixing -> packing.  Each stage works on
all rows its predecessor kept; all but the last return the columns of documents.

Cases.  Null and empty texts, texts without words: judged by the classifiers'
intercepts, without lines, near duplicates of each other, of size 0 in the mix
(they stay once), one closing id when packed.  Null doc_id: not a label's, never
a duplicate that goes, chosen by the other columns, packed with a null id.  Null
source: no boilerplate is found there, a source of its own in the mix.  Repeated
rows: alike in all stages; one stays of those with an id.  Ties: as each operator
states.  Empty tables give no rows; further columns pass through to the last
stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import lines, mixing, neardup, packing, toxicity
from larkspur.plans.staging import stage


#: Words and pieces whose ids a worker keeps while packing, and characters that it numbers together:
#: fewer than when packing alone, as the workers of the stage before the next run still hold them.
PACKING_CACHE_WORDS, PACKING_BLOCK_CHARS = 150_000, 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it learns from ``labels``."""
    return toxicity.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(~F.col("rejected")).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many documents of a source go; every document stays, and n_chars follows its text."""
    kept = lines.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (5-word shingles, Jaccard 0.8): pairs that
    SimHash links, verified, and by MinHash those that it doesn't reach."""
    return neardup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed_rows(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in the sequences."""
    return packing.pack_documents(docs, cache_words=PACKING_CACHE_WORDS, block_chars=PACKING_BLOCK_CHARS, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Classifiers, fingerprints and packing are no SQL; tests/llm holds their operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
