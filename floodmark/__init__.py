"""Table audit operators on Spark DataFrames."""
