"""Declared schemas of the nine marketplace tables.

Spark does not enforce keys or CHECK constraints; those become audit jobs
(``vendora.operators.audit``). VARCHAR/CHAR become plain strings, DECIMAL stays
DECIMAL (money never goes through double), TIMESTAMP is zone-less.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I = T.StringType(), T.IntegerType()
NTZ = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
COORD = T.DecimalType(10, 6)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CUSTOMERS = _schema(("customer_id", S, True), ("customer_unique_id", S, False),
                    ("customer_zip_code", S, True), ("customer_city", S, True),
                    ("customer_state", S, True))
GEOLOCATION = _schema(("geolocation_zip_code", S, True), ("geolocation_lat", COORD, True),
                      ("geolocation_lng", COORD, True), ("geolocation_city", S, True),
                      ("geolocation_state", S, True))
SELLERS = _schema(("seller_id", S, True), ("seller_zip_code", S, True),
                  ("seller_city", S, True), ("seller_state", S, True))
TRANSLATION = _schema(("product_category_name", S, True),
                      ("product_category_name_english", S, True))
PRODUCTS = _schema(("product_id", S, True), ("product_category_name", S, True),
                   ("product_name_length", I, True), ("product_description_length", I, True),
                   ("product_photos_qty", I, True), ("product_weight_g", I, True),
                   ("product_length_cm", I, True), ("product_height_cm", I, True),
                   ("product_width_cm", I, True))
ORDERS = _schema(("order_id", S, True), ("customer_id", S, False), ("order_status", S, True),
                 ("order_purchase_timestamp", NTZ, True), ("order_approved_at", NTZ, True),
                 ("order_delivered_carrier_date", NTZ, True),
                 ("order_delivered_customer_date", NTZ, True),
                 ("order_estimated_delivery_date", NTZ, True))
ORDER_ITEMS = _schema(("order_id", S, True), ("order_item_id", I, True), ("product_id", S, True),
                      ("seller_id", S, True), ("shipping_limit_date", NTZ, True),
                      ("price", MONEY, True), ("freight_value", MONEY, True))
ORDER_PAYMENTS = _schema(("order_id", S, True), ("payment_sequential", I, True),
                         ("payment_type", S, True), ("payment_installments", I, True),
                         ("payment_value", MONEY, True))
ORDER_REVIEWS = _schema(("review_id", S, True), ("order_id", S, True), ("review_score", I, True),
                        ("review_comment_title", S, True), ("review_comment_message", S, True),
                        ("review_creation_date", NTZ, True),
                        ("review_answer_timestamp", NTZ, True))

# Table name -> schema, in the order the row-count report lists them.
TABLES = {
    "customers": CUSTOMERS,
    "geolocation": GEOLOCATION,
    "sellers": SELLERS,
    "product_category_translation": TRANSLATION,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
}

# Declared keys (primary, foreign) used by the audits.
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "product_category_translation": ["product_category_name"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id", "order_id"],
}
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]
NOT_NULL = {"customers": ["customer_unique_id"], "orders": ["customer_id"]}
RANGES = {"order_reviews": {"review_score": (1, 5)}}
# The declared lengths of VARCHAR(n) and CHAR(n) columns.
LENGTHS = {
    "customers": {"customer_id": 50, "customer_unique_id": 50, "customer_zip_code": 10, "customer_city": 100, "customer_state": 2},
    "geolocation": {"geolocation_zip_code": 10, "geolocation_city": 100, "geolocation_state": 2},
    "sellers": {"seller_id": 50, "seller_zip_code": 10, "seller_city": 100, "seller_state": 2},
    "product_category_translation": {"product_category_name": 100, "product_category_name_english": 100},
    "products": {"product_id": 50, "product_category_name": 100},
    "orders": {"order_id": 50, "customer_id": 50, "order_status": 20},
    "order_items": {"order_id": 50, "product_id": 50, "seller_id": 50},
    "order_payments": {"order_id": 50, "payment_type": 30},
    "order_reviews": {"review_id": 50, "order_id": 50},
}
