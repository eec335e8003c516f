"""Analytics of code-generation benchmarks, as Spark DataFrames."""
