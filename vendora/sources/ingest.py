"""CSV ingest and Parquet sinks (operator D0).

The reference loads nine comma-separated files with a header row. Here each
file is read with its declared schema (no inference), and written as Parquet,
the at-rest format every report reads.

Only the review file carries free text that may hold quoted line breaks;
``multiLine`` makes a CSV file unsplittable, so it is switched on only for the
tables that need it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from vendora.operators.audit import row_count_report
from vendora.sources.schemas import TABLES

# Default source file of each table: "<table>.csv"; pass a mapping to override.
SOURCE_FILES = {t: f"{t}.csv" for t in TABLES}
MULTILINE_TABLES = {"order_reviews"}


def read_csv(spark: SparkSession, path: str, table: str, mode: str = "PERMISSIVE",
             bad_records_column: str | None = None) -> DataFrame:
    """Read one source CSV with the table's declared schema.

    ``mode`` is Spark's parse mode: PERMISSIVE keeps malformed rows (fields
    NULL, raw text in ``bad_records_column`` if given), DROPMALFORMED drops
    them, FAILFAST raises. A UTF-8 byte-order mark before the header is
    ignored by the reader.
    """
    schema = TABLES[table]
    if bad_records_column is not None:  # a new StructType: never mutate the shared schema
        schema = StructType(list(schema.fields) + [StructField(bad_records_column, StringType())])
    reader = (spark.read.schema(schema)
              .option("header", "true").option("sep", ",")
              .option("quote", '"').option("escape", '"')
              .option("mode", mode)
              .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
              .option("multiLine", "true" if table in MULTILINE_TABLES else "false"))
    if bad_records_column is not None:
        reader = reader.option("columnNameOfCorruptRecord", bad_records_column)
    return reader.csv(path)


def read_source_folder(spark: SparkSession, folder: str, files: dict[str, str] | None = None,
                       **kw) -> dict[str, DataFrame]:
    folder = folder.rstrip("/")
    names = {**SOURCE_FILES, **(files or {})}
    return {t: read_csv(spark, f"{folder}/{f}", t, **kw) for t, f in names.items()}


REJECT_COLUMNS = ("file", "record", "bad_columns", "fields", "expected")


def load_with_rejects(spark: SparkSession, path: str, table: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Load one source CSV; records that do not fit the declared schema are set
    apart, with the file they come from and their text.

    The records are parsed once, all columns of them, and written to
    ``root/<table>`` with the partition column ``rejected``: what a reader makes of
    a record would otherwise depend on the columns a query happens to read. A
    lost executor costs single tasks of that write.
    Returns (loaded, rejects), both read back from there. ``loaded`` has the
    declared columns. ``rejects`` has ``file, record, bad_columns`` (columns whose
    text has no value of the declared type), ``fields`` and ``expected`` (number of
    fields found and declared; unequal counts reject a record too). Every record
    after the header is in exactly one of the two; an empty file gives two empty
    frames. Blank lines are no records."""
    schema = TABLES[table]
    raw = read_csv(spark, path, table, bad_records_column="__record")
    bad = F.col("__record").isNotNull()
    place = f"{root.rstrip('/')}/{table}"
    (raw.select("*", F.when(bad, F.col("_metadata.file_path")).alias("__file"), bad.alias("rejected"))
     .write.mode("overwrite").partitionBy("rejected").parquet(place))
    nullable = StructType([StructField(f.name, f.dataType) for f in schema.fields])
    stored = StructType([*nullable.fields, StructField("__record", StringType()), StructField("__file", StringType()),
                         StructField("rejected", BooleanType())])
    back = spark.read.schema(stored).parquet(place)
    loaded = back.where(~F.col("rejected")).select(*schema.fieldNames())
    fields = F.from_csv(F.col("__record"), ", ".join(f"{c} STRING" for c in schema.fieldNames()),
                        {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true"})
    again = back.where(F.col("rejected")).withColumn("__text", fields)
    wrong = F.array_compact(F.array(*[
        F.when((F.col(f"__text.{c}") != "") & F.col(c).isNull(), F.lit(c)) for c in schema.fieldNames()]))
    # Separators outside quotes; a quote inside a quoted field is doubled, so it
    # closes and opens again and changes nothing.
    outside = F.regexp_replace("__record", r'"[^"]*("|$)', "")
    rejects = again.select(
        F.col("__file").alias("file"), F.col("__record").alias("record"), wrong.alias("bad_columns"),
        (F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1).cast("int").alias("fields"),
        F.lit(len(schema)).alias("expected"))
    return loaded, rejects


def load_folder_with_rejects(spark: SparkSession, folder: str, root: str,
                             files: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """``load_with_rejects`` for all nine tables: the loaded frames by name and one
    frame of all rejects, with ``table_name``."""
    folder = folder.rstrip("/")
    names = {**SOURCE_FILES, **(files or {})}
    done = {t: load_with_rejects(spark, f"{folder}/{f}", t, root) for t, f in names.items()}
    rejects = [r.select(F.lit(t).alias("table_name"), *REJECT_COLUMNS) for t, (_, r) in done.items()]
    return {t: good for t, (good, _) in done.items()}, reduce(DataFrame.unionByName, rejects)


def load_report(tables: dict[str, DataFrame], rejects: DataFrame) -> DataFrame:
    """The row-count report with what was set apart: ``table_name, row_count,
    rejected_count, read_count`` (the records of the source), by table name."""
    apart = rejects.groupBy("table_name").agg(F.count(F.lit(1)).alias("rejected_count"))
    gone = F.coalesce(F.col("rejected_count"), F.lit(0)).cast("long")
    return (row_count_report(tables).join(apart, "table_name", "left")
            .select("table_name", "row_count", gone.alias("rejected_count"), (F.col("row_count") + gone).alias("read_count"))
            .orderBy("table_name"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Write one table or report as Parquet (executors write in parallel)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Persist all nine tables under ``root/<table>`` with their declared schemas."""
    root = root.rstrip("/")
    for name, df in tables.items():
        write_parquet(df.select(*TABLES[name].fieldNames()), f"{root}/{name}", mode=mode)


# Bucketing keys: the order-level tables share `order_id`, so joins and
# per-order aggregates among them need no shuffle when they are bucketed alike.
BUCKET_KEYS = {
    "orders": "order_id",
    "order_items": "order_id",
    "order_payments": "order_id",
    "order_reviews": "order_id",
    "customers": "customer_id",
    "products": "product_id",
}


def write_bucketed_tables(tables: dict[str, DataFrame], root: str, buckets: int,
                          database: str = "vendora") -> None:
    """Persist the nine tables as bucketed Parquet tables in the session catalog.

    Each bucketed table is hash-partitioned on its key into ``buckets`` files
    (one per bucket: the write repartitions with the same hash the bucketing
    uses), registered as ``database.table`` with its location under ``root``.
    Later joins and aggregates on the key between tables with the same bucket
    count read co-located data instead of shuffling it. Size ``buckets`` so
    one bucket of the largest table is a few hundred MB.
    """
    spark = next(iter(tables.values())).sparkSession
    root = root.rstrip("/")
    if not re.fullmatch(r"[A-Za-z0-9_]+", database):
        raise ValueError(f"not a database name: {database!r}")
    place = f"{root}/_{database}.db".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{place}'")
    for name, df in tables.items():
        df = df.select(*TABLES[name].fieldNames())
        key = BUCKET_KEYS.get(name)
        if key:
            w = (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
                 .bucketBy(buckets, key).sortBy(key))
        else:
            w = df.write.mode("overwrite").format("parquet")
        w.option("path", f"{root}/{name}").saveAsTable(f"{database}.{name}")
