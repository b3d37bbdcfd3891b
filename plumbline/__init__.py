"""plumbline: annotation benchmarks, scoring and corpus preparation on Spark DataFrames."""
