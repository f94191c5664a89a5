"""Survey and count-data analytics on Spark DataFrames."""
