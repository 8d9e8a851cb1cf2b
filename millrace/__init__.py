"""millrace: rule evaluation, routing, interval, time-series and gating operators for Spark DataFrames."""
