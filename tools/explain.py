"""Print Spark's formatted physical plan for reports.

Usage: python tools/explain.py [--bucketed] sf_dir key [key ...]
With --bucketed the nine tables are first written as bucketed tables (into a
fresh folder under the session's checkpoint dir) and read through the catalog.
"""

from __future__ import annotations

import sys
import uuid

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from vendora.plans import REGISTRY  # noqa: E402
from vendora.session import get_session, shared_path  # noqa: E402
from vendora.sources import adapter, ingest  # noqa: E402
from vendora.sources.catalog import from_catalog, from_testdata  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    bucketed = "--bucketed" in args
    args = [a for a in args if a != "--bucketed"]
    sf_dir, keys = args[0], args[1:]
    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    if bucketed:
        root = shared_path(spark, f"vendora-explain-{uuid.uuid4().hex[:8]}")
        ingest.write_bucketed_tables(adapter.derive_all(spark, sf_dir), root, 8, database="vendora_explain")
        tables = from_catalog(spark, "vendora_explain")
    else:
        tables = from_testdata(spark, sf_dir)
    for key in keys:
        print(f"===== {key} =====")
        REGISTRY[key](tables).explain("formatted")


if __name__ == "__main__":
    main()
