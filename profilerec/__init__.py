"""Customer, product and journey profiling plus hybrid recommendation on Spark DataFrames."""
