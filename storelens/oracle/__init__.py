"""Independent ANSI SQL (DuckDB dialect) for every SQL-expressible key.

Each string is self-contained: it derives the star views from the base tables with CTEs
and then runs the source query as written, plus explicit tie-breaks / NULL ordering and
explicit result types. DuckDB's AVG and decimal division return DOUBLE; ``R(x, n)``
restores exact-decimal half-up rounding so both engines round the same values.
"""
