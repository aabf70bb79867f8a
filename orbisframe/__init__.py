"""Earth-observation and spatial analytics on Spark DataFrames."""
