"""Time-series analytics on Spark: bars, activation signals, causal joins, forecasts and their tests."""
