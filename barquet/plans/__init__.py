"""Composed jobs.

- ``reports``: daily and morning reports (D1, D2)
- ``models``: open-to-close regression for a day or a range (D5)
- ``analytics``: series forecast + anomaly job (D6), lag-window forecast of a report (D7)
- ``etl``: dated runs: extract, report, store, read back (D3 + D1/D2 + D4)
- ``registry``: the named queries over the driver's tables and their DuckDB oracles
"""
