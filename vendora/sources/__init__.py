"""Sources and sinks: schemas, testdata adapter, CSV ingest, Parquet."""

from vendora.sources.catalog import Tables, from_parquet, from_testdata  # noqa: F401
