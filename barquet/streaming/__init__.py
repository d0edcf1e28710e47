"""Incremental (Structured Streaming) form of the dated daily and morning runs (``incremental``)."""
