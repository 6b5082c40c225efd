"""citeloom: citation-grounded document analytics on Spark DataFrames."""
