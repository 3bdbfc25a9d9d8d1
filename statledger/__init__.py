"""Sports-statistics warehouse built on Spark DataFrames."""
