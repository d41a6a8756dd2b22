"""The nine-table catalog a report runs against.

``Tables`` is a plain holder of DataFrames. It can come from
* the testdata adapter (``from_testdata``; lazy, used by the driver contract),
* Parquet files written by the ingest step (``from_parquet``), or
* any dict of DataFrames (tests build small hand-made frames this way).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vendora.sources import adapter
from vendora.sources.schemas import TABLES


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    geolocation: DataFrame
    sellers: DataFrame
    translation: DataFrame
    products: DataFrame
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame

    @staticmethod
    def from_dict(d: dict[str, DataFrame]) -> "Tables":
        return Tables(customers=d["customers"], geolocation=d["geolocation"],
                      sellers=d["sellers"], translation=d["product_category_translation"],
                      products=d["products"], orders=d["orders"], items=d["order_items"],
                      payments=d["order_payments"], reviews=d["order_reviews"])

    def as_dict(self) -> dict[str, DataFrame]:
        return {"customers": self.customers, "geolocation": self.geolocation,
                "sellers": self.sellers, "product_category_translation": self.translation,
                "products": self.products, "orders": self.orders,
                "order_items": self.items, "order_payments": self.payments,
                "order_reviews": self.reviews}

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession


def from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """Adapter tables over ``sf_dir`` (lazy)."""
    return Tables.from_dict(adapter.derive_all(spark, sf_dir.rstrip("/")))


def from_parquet(spark: SparkSession, root: str) -> Tables:
    """Tables previously written by ``vendora.sources.ingest.write_tables``."""
    root = root.rstrip("/")
    return Tables.from_dict({name: spark.read.schema(schema).parquet(f"{root}/{name}")
                             for name, schema in TABLES.items()})


def from_catalog(spark: SparkSession, database: str = "vendora") -> Tables:
    """Tables registered by ``vendora.sources.ingest.write_bucketed_tables``
    (read through the catalog, so Spark knows their bucketing)."""
    return Tables.from_dict({name: spark.table(f"{database}.{name}") for name in TABLES})
