"""barloom: bar-based time-series research on Spark DataFrames."""
