"""vendora: marketplace analytics as Spark DataFrame jobs.

Layout
------
sources/    table schemas, the testdata adapter, CSV ingest and Parquet sinks
functions/  column expressions: exact rounding, durations, calendar labels
operators/  reusable distributed operators (audits, shares, exact percentiles,
            global ranks, trends, cohorts, RFM, bucketing, fan-out safe joins)
plans/      the named analytic reports, one function per report
streaming/  intentionally empty: the analytics suite has no streaming input
"""

__version__ = "0.1.0"
