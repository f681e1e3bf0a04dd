"""promptscreen: screening of texts at scale with Spark DataFrames."""
