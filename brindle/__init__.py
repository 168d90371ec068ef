"""Document search, analytics and reporting expressed as Spark DataFrames."""
