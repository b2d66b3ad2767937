"""Leakage-safe time-series features, backtests and leaderboards as Spark jobs."""
