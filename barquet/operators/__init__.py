"""Relational and model operators over bars, reports and series.

- ``bars``: cleaning, first/last by time, daily and morning OHLCV, open/close attach, counts (P1, P2, A1-A6, W1, W2, D8)
- ``ordering``: distributed dense row index, top-k, last-k per key, latest value (W4, O3-O7, W8, F11)
- ``series``: blocked lags/leads, discounted sums, splits, lag windows, min-max scaling (W5-W7, M2, A10)
- ``regression``: OLS, linregress with Student-t p value, next-day scoring (M1, M1b, M1c, A9)
- ``forecast``: AR(1), ARMA(1,1) two-stage fit and least-squares refinement (M6b, M6)
- ``anomaly``: one-class RBF flags (M7)
- ``mlmodels``: MLlib multi-feature regression, lag-window forecaster, sigmoid unit (M3, M4, M5)
- ``metrics``: RMSE and MSE (A7, A8); ``charts``: chart-ready tables (M8, U3)
"""
