"""spanlight: reach, trend and matching analytics on Spark DataFrames."""
