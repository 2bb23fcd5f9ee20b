"""Source-attributed knowledge analytics over Spark DataFrames."""
