"""Multi-model analytics over ordinary Spark DataFrames."""
