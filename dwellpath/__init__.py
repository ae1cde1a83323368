"""Movement-timeline analytics on Spark DataFrames."""
