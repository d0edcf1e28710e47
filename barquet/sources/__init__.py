"""Sources and sinks.

- ``schemas``: declared schemas (nothing is inferred)
- ``fixtures``: bar-shaped and series views over the driver's tables, in Spark and DuckDB form
- ``files``: dated CSV trees, strict and by-header-name reads, close-series files, the Parquet
  report store and its latest report (S1-S10, D3, D4)
"""
