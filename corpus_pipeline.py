"""From raw documents to packed training sequences: each stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameclinic.llm.common import table, utf8
from frameclinic.llm.decontaminate import remove_contamination
from frameclinic.llm.language_id import UNKNOWN, learn, predict, remainder
from frameclinic.llm.minhash_dedup import near_duplicates
from frameclinic.llm.packing import pack
from frameclinic.llm.queries import VOCABULARY
from frameclinic.llm.suffix_dedup import remove_repeats
from frameclinic.sources.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language the n-gram filters can name, with that language; those without a letter go."""
    filters = learn(docs.where(remainder(4) != 2))
    named = predict(docs, filters, tuple(COLUMNS)).where(F.col("lang_pred") != UNKNOWN)
    return named.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8): that of the least number.

    Rows are judged by their text, so numbers may be missing or repeated: a row without a number stands for a group
    only if none of it has one, and other texts with a number of the group stay. Rows without a word are linked with
    nothing and stay.
    """
    docs = docs.select(*COLUMNS)
    key = F.xxhash64(utf8("text"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), size=5, percent=80)
    group = found.groupBy(F.col("doc_id").alias("key")).agg(F.max("n_shingles").alias("size"), F.min("component_id").alias("group"))
    rows = docs.select(key.alias("key"), F.col("doc_id").alias("number")).groupBy("key", "number").agg(F.count("*").alias("n"))
    rows = materialise(rows.join(group, "key"), "pipeline-groups")
    first = F.min(F.struct(F.col("number").isNull().alias("none"), "number", "key", "n")).alias("first")
    chosen = rows.where("size > 0").groupBy("group").agg(first).select("first.key", "first.number", "first.n")
    wordless = rows.where("size = 0").select("key", "number", F.lit(1).cast("long").alias("n"))
    chosen = materialise(chosen.unionByName(wordless), "pipeline-chosen")

    def having(some: DataFrame) -> DataFrame:
        return docs.join(some, (key == some.key) & docs.doc_id.eqNullSafe(some.number), "left_semi")

    kept = having(chosen.where("n = 1"))
    again = chosen.where("n > 1")
    if not again.isEmpty():  # rows that repeat both the text and the number
        one = having(again).groupBy(key.alias("key")).agg(F.min(F.struct(*COLUMNS)).alias("one"))
        kept = kept.unionByName(one.select("one.*"))
    return kept


def _replaced(docs: DataFrame, column: str) -> DataFrame:
    """``column`` (bytes) as the text; broken characters at its cuts and documents with nothing left go."""
    text = F.col(column).cast("string")
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    docs = docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return docs.where(F.length(F.trim("text")) > 0).select(*COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that start anywhere else too."""
    return _replaced(remove_repeats(docs, width=200, keep=("lang", "source")), "kept_bytes")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the merged stretches of ten words that a benchmark item has too."""
    clean = remove_contamination(docs, table(spark, folder, "benchmark"), window=10, keep=("lang", "source"))
    return _replaced(clean, "clean")


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of at most 4096."""
    return pack(docs, public_tokenizers.path(VOCABULARY), length=4096, end_id=2, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Classifiers, near-duplicates and packing have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again as the next one's input."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, folder), f"pipeline-{name}")
    return docs


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder)
