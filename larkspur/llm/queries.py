"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import lines, preferences, substrings, topk
from larkspur.llm.language import identify
from larkspur.llm.media import store_payloads
from larkspur.llm.mixing import mix_sources
from larkspur.llm.packing import pack_documents
from larkspur.llm.simhash import near_duplicates
from larkspur.llm.substrings import remove_repeats
from larkspur.llm.toxicity import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_payloads(_table(spark, sf_dir, "documents"), with_media=False)


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # conversations 2k and 2k + 1 are the chosen and the rejected one of pair k
    turns = _table(spark, sf_dir, "conversations")
    return preferences.format_preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 0)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("rejected").alias("toxic"), F.col("p_toxic").alias("score"), "p_low_quality", "p_toxic", "p_toxic_low_quality")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op1_language": op1_language, "op2_media": op2_media, "op3_preferences": op3_preferences, "op4_topk": op4_topk, "op5_simhash": op5_simhash, "op6_toxicity": op6_toxicity, "op7_lines": op7_lines, "op8_substrings": op8_substrings, "op9_packing": op9_packing, "op10_mixing": op10_mixing}

ORACLE_SQL = {"op3_preferences": preferences.ORACLE, "op4_topk": topk.ORACLE, "op7_lines": lines.ORACLE, "op8_substrings": substrings.ORACLE}
