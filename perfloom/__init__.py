"""Analytics on performance-benchmark data and the findings drawn from it, on Spark DataFrames."""
