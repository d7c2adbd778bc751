"""Event-log analytics on Spark DataFrames."""
