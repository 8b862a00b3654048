"""Review analytics and product recommendation on Spark DataFrames."""
