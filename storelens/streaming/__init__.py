"""Structured Streaming entry points.

The source system is batch-only (no stream source, watermark or state anywhere). The one
place where data *arrives over time* is the staging import run in append mode; that is
what ``ingest`` expresses as a file-source stream with exactly-once parquet output.
"""
