"""tidewatch: usage and cost analytics on Spark DataFrames."""
