"""The corpus pipeline: each stage works on all that its predecessor kept.

1. language: documents without a language go (hyperdimensional profiles).
2. near_duplicates: one document of each class of near copies (five-word shingles, 0.8 or more) stays
   (fast similarity sketches).
3. repeated_passages: passages of 50 bytes that an earlier document holds are cut out (suffix
   arrays); documents of which nothing is left go.
4. decontaminate: documents that hold a benchmark item go (templates).
5. packing: what is left is packed into sequences of 4096 tokens (multiway differencing).

Stages 1 to 4 return the columns of ``documents``, the last one pieces and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, language, neardup, packing, suffix
from tilewright.llm.common import read, stored

#: Near copies share this much of their five-word shingles.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return neardup.keep_one_of_each(docs, NEAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document holds; ``n_chars`` follows the text."""
    cut = suffix.remove_repeats(docs, spans_col="__removed")
    kept = cut.where((F.size("__removed") == 0) | (F.length("text") > 0)).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.sequences(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", drop_benchmarks),
    ("packing", pack_sequences),
]

#: Profiles, sketches and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
