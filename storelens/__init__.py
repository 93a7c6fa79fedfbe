"""storelens: app-marketplace analytics expressed as Spark DataFrame / SQL / ML jobs.

Layout
------
sources/    readers, writers and the derived star views over the test tables
functions/  column-expression builders (parsers, text cleaning, tiers, label maps)
operators/  reusable relational building blocks (top-k, ranks, shares, guarded joins)
plans/      the operator catalogue: star build, quality suite, analytics,
            dashboard, corpus / text profiling, model training and evaluation
streaming/  incremental staging ingestion with Structured Streaming
oracle/     independent ANSI SQL for every SQL-expressible key (DuckDB-runnable)
"""

__version__ = "0.1.0"
