"""Registered queries of the operators: each applies one operator, with
production parameters, to its whole table; ``ORACLE`` holds DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm import chat, decontaminate, divergence, licenses, linededup, merkle, mixing, pii, quality, secretscan, simhash, sphere, urlfilter
from vendora.llm.common import table
from vendora.llm.sql import ORACLE_OP1, ORACLE_OP4, ORACLE_OP5, ORACLE_OP8, ORACLE_OP10, ORACLE_OP11, ORACLE_OP13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query(ORACLE_OP1)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(ORACLE_OP4)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(ORACLE_OP5)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of control strings."""
    tricky = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.read_back(chat.segments(turns.unionByName(own)))


@query(ORACLE_OP8)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


@query()
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


# The rules of the URL filter query.
URL_RULES = [urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "example.net", "/en/"),
             urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]


@query(ORACLE_OP10)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose id is the page's: bad if of low quality or toxic."""
    outcomes = (table(spark, sf_dir, "labels")
                .where("quality is not null or toxic is not null")
                .select(F.col("doc_id").alias("page_id"),
                        F.coalesce(F.expr("quality <=> 0 or toxic <=> 1"), F.lit(False)).alias("bad")))
    return urlfilter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


@query(ORACLE_OP11)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row proved, then a fifth of the rows tampered with and folded again."""
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


@query(ORACLE_OP13)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query()
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))
