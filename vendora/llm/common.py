"""Helpers shared by the operators: ASCII lower case, word lists, tables written
to the shared folder, checked broadcasts."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.session import shared_path

# Everything that is not a word character once A-Z are lower-cased: control
# characters, punctuation and symbols of ASCII. All other code points are.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Rows that one broadcast may hold; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other code point unchanged. Pure ASCII text takes the
    built-in lower(), which on such text does just that and is far faster."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_list(text: Column) -> Column:
    """Lower-cased words of a text, in order; null and empty text have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash (in any case) with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and
    still there when executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the counted rows are within ``limit``; otherwise
    the frame is left to Spark, which shuffles it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
