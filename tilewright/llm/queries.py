"""The registered queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import decontaminate, filteraudit, language, lexical, neardup, packing, prefixtree, shards, sitetree, suffix, tokens, topk, urls
from tilewright.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return wrap


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(read(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(read(spark, sf_dir, "documents"))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


@query("op3_decontaminate", decontaminate.ORACLE)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op5_shards")
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(read(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(read(spark, sf_dir, "documents"))


@query("op4_top_k")
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(read(spark, sf_dir, "embeddings"))


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(read(spark, sf_dir, "pages"))


@query("op7_urls")
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


@query("op11_filter_audit", filteraudit.ORACLE)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op12_lexical_search", lexical.ORACLE)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_ngram_join", prefixtree.ORACLE)
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.join(read(spark, sf_dir, "documents"))
