"""Run reports and store them: ``python -m vendora.cli``.

Sources (one of):
  --testdata DIR   the driver's TPC-H-style testdata, mapped by the adapter
  --csv DIR        the nine source CSVs (``<table>.csv``), read with declared schemas
  --parquet DIR    tables written earlier by ``--write-tables`` (``DIR/<table>``)

Actions:
  --write-tables DIR [--buckets N]   persist the nine tables as Parquet
                                     (bucketed by key when --buckets is given)
  --out DIR [--reports k1,k2]        write each report to ``DIR/<key>`` as Parquet
  --monthly DIR [--late DIR2]        keep the folds of the monthly reports in DIR: all
                                     months, or those that the late rows in DIR2
                                     (``DIR2/<table>`` as Parquet: orders, order_items,
                                     customers, and orders_before: corrected orders as
                                     they were) change; reports go to ``DIR/_reports``
  --list                             print the report keys

Reports are written by the executors (``DataFrame.write.parquet``); nothing
is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException

from vendora.plans import REGISTRY
from vendora.plans.monthly import monthly_reports, refresh
from vendora.session import get_session
from vendora.sources import adapter, ingest
from vendora.sources.catalog import Tables, from_catalog, from_parquet, from_testdata
from vendora.sources.schemas import TABLES


def _tables(spark, args) -> Tables:
    if args.testdata:
        return from_testdata(spark, args.testdata)
    if args.csv and args.load_root:
        loaded, rejects = ingest.load_folder_with_rejects(spark, args.csv, args.load_root)
        ingest.write_parquet(rejects, f"{args.load_root.rstrip('/')}/_rejects")
        return Tables.from_dict(loaded)
    if args.csv:
        return Tables.from_dict(ingest.read_source_folder(spark, args.csv))
    if args.parquet:
        return from_parquet(spark, args.parquet)
    raise SystemExit("give one source: --testdata, --csv or --parquet")


def _late_rows(spark, folder: str) -> dict:
    """Late rows by table name; a table without a folder has none."""
    found = {}
    for name in ("orders", "order_items", "customers", "orders_before"):
        try:
            found[name] = spark.read.schema(TABLES[name.removesuffix("_before")]).parquet(f"{folder.rstrip('/')}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="vendora", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group()
    src.add_argument("--testdata")
    src.add_argument("--csv")
    src.add_argument("--parquet")
    ap.add_argument("--load-root", help="with --csv: load there, with unfit records set apart in _rejects")
    ap.add_argument("--write-tables")
    ap.add_argument("--buckets", type=int)
    ap.add_argument("--out")
    ap.add_argument("--reports", help="comma-separated keys (default: all)")
    ap.add_argument("--monthly", help="folder of the monthly reports' folds")
    ap.add_argument("--late", help="with --monthly: folder of the rows that came late")
    ap.add_argument("--list", action="store_true")
    ap.add_argument("--master")
    args = ap.parse_args(argv)

    if args.list:
        print("\n".join(REGISTRY))
        return 0
    spark = get_session(args.master)
    tables = _tables(spark, args)
    if args.write_tables:
        if args.buckets:
            ingest.write_bucketed_tables(tables.as_dict(), args.write_tables, args.buckets)
            tables = from_catalog(spark)
        else:
            ingest.write_tables(tables.as_dict(), args.write_tables)
            tables = from_parquet(spark, args.write_tables)
    if args.monthly:
        late = _late_rows(spark, args.late) if args.late else None
        before = late.pop("orders_before", None) if late else None
        months = refresh(tables, args.monthly, late, before)
        print("refreshed " + ("all months" if months is None else f"{len(months)} months"), file=sys.stderr)
        for key, frame in monthly_reports(spark, args.monthly).items():
            ingest.write_parquet(frame, f"{args.monthly.rstrip('/')}/_reports/{key}")
    if args.out:
        keys = args.reports.split(",") if args.reports else list(REGISTRY)
        unknown = [k for k in keys if k not in REGISTRY]
        if unknown:
            raise SystemExit(f"unknown reports: {', '.join(unknown)}")
        for key in keys:
            ingest.write_parquet(REGISTRY[key](tables), f"{args.out.rstrip('/')}/{key}")
            print(f"wrote {key}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
