"""Run-telemetry analytics on Spark: typed tables in, DataFrames out."""
