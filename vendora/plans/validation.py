"""Load validation: row counts of the nine tables (V1)."""

from __future__ import annotations

from vendora.operators.audit import row_count_report
from vendora.oracle import with_tables
from vendora.plans.common import report
from vendora.sources.catalog import Tables

_NAMES = ["customers", "geolocation", "sellers", "product_category_translation", "products",
          "orders_m", "order_items", "order_payments", "order_reviews"]

ORACLE_V1 = with_tables(" UNION ALL ".join(
    f"SELECT '{n.replace('orders_m', 'orders')}' AS table_name, COUNT(*) AS row_count FROM {n}"
    for n in _NAMES) + " ORDER BY table_name")


@report("validate_row_counts", ORACLE_V1)
def validate_row_counts(t: Tables):
    return row_count_report(t.as_dict())
