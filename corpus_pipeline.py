"""Training-corpus pipeline over ``documents``: quality classifier, line dedup,
SimHash near-dedup, benchmark decontamination, mixing of sources.

Each stage takes (spark, docs, sf_dir), calls one operator on all rows of
``docs`` and returns the rows it keeps with the columns of ``docs``; the last one
returns the mixed copies with their place. ``run`` writes each stage's result to
the shared folder and reads it back for the next, so a lost executor costs at
most one stage. The quality and SimHash operators are no SQL, so there is no
``ORACLE_SQL``; the tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm import decontaminate, linededup, mixing, quality, simhash
from vendora.llm.common import fresh, stored, table

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score under ``quality.CUT``)."""
    score = fresh(docs, "quality_score")[0]
    scored = quality.with_score(docs, table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) >= quality.CUT).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, all but the earliest; so do documents that lose all words."""
    return linededup.dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: copies with ``copy`` and ``shuffle_key``."""
    return mixing.mix(docs)


STAGES = [("quality", keep_quality), ("line_dedup", dedup_lines), ("simhash", dedup_near),
          ("decontaminate", decontaminated), ("mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
