"""Registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameclinic.llm.chat_format import chat_digests
from frameclinic.llm.collocations import mine_collocations
from frameclinic.llm.common import table
from frameclinic.llm.decontaminate import find_contamination, with_digest
from frameclinic.llm.hard_negatives import mine_hard_negatives
from frameclinic.llm.html_extract import extract_text
from frameclinic.llm.language_id import learn, predict, remainder
from frameclinic.llm.minhash_dedup import near_duplicates
from frameclinic.llm.packing import pack
from frameclinic.llm.pivot_index import similar_vectors
from frameclinic.llm.substring_trees import remove_shared_passages
from frameclinic.llm.suffix_dedup import remove_repeats
from frameclinic.llm.toxicity import fit, score_toxicity
from frameclinic.llm.url_rules import judge_urls

#: The public vocabulary that the packing query counts by.
VOCABULARY = "word_bpe_49k.json"

#: Rules of the url query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return with_digest(find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), width=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), length=4096, end_id=2)


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(rows.unionByName(more))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    filters = learn(docs.where(remainder(4) != 2))
    return predict(docs.withColumn("held_out", held_out), filters, ("doc_id", "held_out"))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors(table(spark, folder, "embeddings"), least=0.9)


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = fit(docs.where(remainder(5) != 0), table(spark, folder, "labels").where(remainder(5) != 0))
    return score_toxicity(docs.withColumn("held_out", held_out), model, ("doc_id", "held_out"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_shared_passages(table(spark, folder, "documents"), words=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return mine_collocations(table(spark, folder, "documents"), longest=3, least=10, inside=50, most=2000)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0, label, positives=5, negatives=3, low=50, high=95, scale=256.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_decontamination,
        op3_suffix_dedup,
        op4_packing,
        op5_html_extraction,
        op6_chat_formatting,
        op7_language_id,
        op8_embedding_dedup,
        op9_url_filter,
        op10_toxicity,
        op11_substring_dedup,
        op12_collocations,
        op13_hard_negatives,
    )
}
