"""Document-originality and corpus analytics on Spark DataFrames."""
