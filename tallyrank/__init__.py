"""Transaction risk scoring and product ranking on Spark DataFrames."""
