"""Document search and cluster analytics on Spark: every operator takes DataFrames and returns one."""
