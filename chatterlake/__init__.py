"""Social-post analytics on Spark: bronze, silver and gold layers as DataFrames."""
