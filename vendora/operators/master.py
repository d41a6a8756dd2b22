"""The denormalised order frame (operator P1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendora.sources.catalog import Tables


def master_orders(t: Tables, orders=None, ids=None):
    """The denormalised order frame (seven left joins from orders).

    ``ids`` (optional, a small frame of order ids - broadcast it) restricts
    every satellite to those order ids first, through a semi join. Payments
    are filtered to sequence 1 before the join. Money keeps its own type.
    """
    o = t.orders if orders is None else orders

    def only(df):
        return df if ids is None else df.join(ids, "order_id", "left_semi")

    items = only(t.items).select("order_id", "product_id", "seller_id", "price", "freight_value")
    pays = only(t.payments).where(F.col("payment_sequential") == 1).select(
        "order_id", "payment_type", "payment_value")
    revs = only(t.reviews).select("order_id", "review_score")
    o = o.select("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                 "order_delivered_customer_date", "order_estimated_delivery_date")
    cust = t.customers.select("customer_id", "customer_city", "customer_state")
    prod = t.products.select("product_id", "product_category_name")
    sell = t.sellers.select("seller_id", "seller_state")
    if ids is not None:
        # Dimension rows of the selected orders only; the key sets are small at
        # runtime, so AQE broadcasts them (size-checked) instead of shuffling
        # the dimensions.
        cust = cust.join(o.select("customer_id").distinct(), "customer_id", "left_semi")
        prod = prod.join(items.select("product_id").distinct(), "product_id", "left_semi")
        sell = sell.join(items.select("seller_id").distinct(), "seller_id", "left_semi")
    prod = prod.join(t.translation, "product_category_name", "left")
    j = (o.join(cust, "customer_id", "left")
         .join(items, "order_id", "left")
         .join(prod.select("product_id", "product_category_name_english"), "product_id", "left")
         .join(sell, "seller_id", "left")
         .join(pays, "order_id", "left")
         .join(revs, "order_id", "left"))
    return j.select(
        "order_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
        "order_estimated_delivery_date", "customer_city", "customer_state",
        "price", "freight_value",
        F.coalesce(F.col("product_category_name_english"), F.lit("Unknown")).alias("category_english"),
        "seller_state", "payment_type", "payment_value",
        "review_score")
