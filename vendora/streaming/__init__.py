"""Streaming: intentionally empty.

The analytics suite this engine rebuilds has no stream source, watermark,
window over event time or state (survey section 2.11): every report is a batch
query over at-rest tables. Reports return DataFrames, so a user who needs one
refreshed on arrival can run it from ``foreachBatch`` over their own stream.
"""
