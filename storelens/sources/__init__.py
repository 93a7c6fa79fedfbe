"""Sources and sinks: raw CSV ingest, derived fixture views, table writers."""
