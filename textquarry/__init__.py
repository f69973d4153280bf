"""Document intelligence and analytics on Spark DataFrames."""
