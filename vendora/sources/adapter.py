"""Derive the nine marketplace tables from the driver's TPC-H-style testdata.

The mapping is the deterministic derivation fixed in FIXTURES.md section C; the
oracle carries the same derivation as SQL CTEs (``vendora.oracle``). Every
table is a lazy DataFrame over the raw Parquet files, so Catalyst prunes
columns and pushes filters into the scans of each report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _s(col) -> F.Column:
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def _add(unit: str, n, ts) -> F.Column:
    return F.timestamp_add(unit, n.cast("int"), ts)


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in RAW_TABLES}


def customers(raw) -> DataFrame:
    o, c = raw["orders"], raw["customer"]
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("C"), _s(k)).alias("customer_id"),
        F.concat(F.lit("U"), _s(F.when(k % 4 == 0, F.col("o_custkey"))
                                .otherwise(F.lit(1000000000) + k))).alias("customer_unique_id"),
        F.lpad(_s(F.col("c_custkey") % 1000), 5, "0").alias("customer_zip_code"),
        F.col("c_mktsegment").alias("customer_city"),
        F.lpad(_s("c_nationkey"), 2, "0").alias("customer_state"))


def geolocation(raw) -> DataFrame:
    n = F.col("n_nationkey")
    return raw["nation"].select(
        F.lpad(_s(n), 5, "0").alias("geolocation_zip_code"),
        (n * -1).cast("decimal(10,6)").alias("geolocation_lat"),
        (n * -2).cast("decimal(10,6)").alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"),
        F.lpad(_s(n), 2, "0").alias("geolocation_state"))


def sellers(raw) -> DataFrame:
    s = F.col("s_suppkey")
    return raw["supplier"].select(
        F.concat(F.lit("S"), _s(s)).alias("seller_id"),
        F.lpad(_s(s % 1000), 5, "0").alias("seller_zip_code"),
        F.concat(F.lit("CITY_"), _s(s % 10)).alias("seller_city"),
        F.lpad(_s("s_nationkey"), 2, "0").alias("seller_state"))


def translation(raw) -> DataFrame:
    return (raw["part"].where(F.col("p_brand") != "Brand#7").select("p_brand").distinct()
            .select(F.col("p_brand").alias("product_category_name"),
                    F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
                    .alias("product_category_name_english")))


def products(raw) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return raw["part"].select(
        F.concat(F.lit("P"), _s(k)).alias("product_id"),
        F.when(k % 53 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
        .alias("product_category_name"),
        F.length("p_name").cast("int").alias("product_name_length"),
        (F.length("p_name") * 10).cast("int").alias("product_description_length"),
        (k % 6).cast("int").alias("product_photos_qty"),
        F.when(k % 97 == 0, F.lit(None).cast("int")).otherwise(size * 100).alias("product_weight_g"),
        size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"),
        (size + 2).alias("product_width_cm"))


def _orders_base(raw) -> DataFrame:
    k = F.col("o_orderkey")
    return raw["orders"].select(
        k.alias("k"),
        F.concat(F.lit("O"), _s(k)).alias("order_id"),
        F.concat(F.lit("C"), _s(k)).alias("customer_id"),
        F.when(k % 40 == 0, "canceled").when(k % 41 == 0, "unavailable")
        .when(F.col("o_orderstatus") == "P", "shipped").otherwise("delivered").alias("order_status"),
        _add("SECOND", k * 7919 % 86400, F.col("o_orderdate")).alias("pts"))


def orders(raw, base: DataFrame | None = None) -> DataFrame:
    b = base if base is not None else _orders_base(raw)
    k, pts, st = F.col("k"), F.col("pts"), F.col("order_status")
    late_extra = F.when(k % 100 > 90, 310).otherwise(0)
    return b.select(
        "order_id", "customer_id", "order_status",
        pts.alias("order_purchase_timestamp"),
        F.when(k % 101 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(_add("HOUR", k % 48, pts)).alias("order_approved_at"),
        F.when(st.isin("delivered", "shipped") & (k % 107 != 0),
               _add("HOUR", 24 + k * 17 % 96, pts)).alias("order_delivered_carrier_date"),
        F.when((st == "delivered") & (k % 103 != 0),
               _add("HOUR", 130 + k * 37 % 900 + late_extra, pts))
        .alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(40), F.to_date(pts).cast("timestamp_ntz"))
        .alias("order_estimated_delivery_date"))


def order_items(raw) -> DataFrame:
    ok = F.col("l_orderkey")
    return raw["lineitem"].select(
        F.concat(F.lit("O"), _s(ok)).alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.concat(F.lit("P"), _s("l_partkey")).alias("product_id"),
        F.concat(F.lit("S"), _s(F.col("l_suppkey") % (ok % 100 + 1))).alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        (F.col("l_quantity").cast("int").cast("decimal(10,2)")
         * F.lit(0.37).cast("decimal(3,2)")).cast("decimal(10,2)").alias("freight_value"))


def order_payments(raw, items: DataFrame | None = None) -> DataFrame:
    it = items if items is not None else order_items(raw)
    base = (it.groupBy("order_id")
            .agg(F.sum(F.col("price") + F.col("freight_value")).cast("decimal(18,2)").alias("tot"))
            .withColumn("k", F.substring("order_id", 2, 1 << 30).cast("bigint")))
    k, tot = F.col("k"), F.col("tot")
    kept = base.where(k % 499 != 0)
    first = kept.select(
        "order_id", F.lit(1).alias("payment_sequential"),
        F.when(k % 4 == 0, "boleto").otherwise("credit_card").alias("payment_type"),
        (k % 10 + 1).cast("int").alias("payment_installments"),
        (tot - F.when(k % 10 == 0, 5).otherwise(0) + F.when(k % 300 == 7, 1).otherwise(0))
        .cast("decimal(10,2)").alias("payment_value"))
    voucher = kept.where(k % 10 == 0).select(
        "order_id", F.lit(2).alias("payment_sequential"), F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        F.lit(5).cast("decimal(10,2)").alias("payment_value"))
    return first.unionByName(voucher)


def order_reviews(raw, base: DataFrame | None = None) -> DataFrame:
    b = base if base is not None else _orders_base(raw)
    k, pts = F.col("k"), F.col("pts")
    first = b.where(k % 9 != 0).select(
        F.concat(F.lit("R"), _s(k)).alias("review_id"), "order_id",
        F.when(k % 7 == 0, 1).when(k % 2 == 0, 5).otherwise(k * 13 % 3 + 3).cast("int")
        .alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "  ").otherwise("ok")
        .alias("review_comment_message"),
        F.timestamp_add("DAY", F.lit(40), pts).alias("review_creation_date"),
        F.timestamp_add("DAY", F.lit(42), pts).alias("review_answer_timestamp"))
    second = b.where(k % 25 == 0).select(
        F.concat(F.lit("R"), _s(k), F.lit("b")).alias("review_id"), "order_id",
        (k % 5 + 1).cast("int").alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.timestamp_add("DAY", F.lit(45), pts).alias("review_creation_date"),
        F.timestamp_add("DAY", F.lit(46), pts).alias("review_answer_timestamp"))
    return first.unionByName(second)


def derive_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All nine tables as lazy DataFrames keyed by their reference names."""
    raw = read_raw(spark, sf_dir)
    base = _orders_base(raw)
    items = order_items(raw)
    return {
        "customers": customers(raw),
        "geolocation": geolocation(raw),
        "sellers": sellers(raw),
        "product_category_translation": translation(raw),
        "products": products(raw),
        "orders": orders(raw, base),
        "order_items": items,
        "order_payments": order_payments(raw, items),
        "order_reviews": order_reviews(raw, base),
    }
