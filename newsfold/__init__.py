"""News-article analytics on Spark DataFrames."""
