"""cellwise: learning from compact summaries of gridded data, on Spark DataFrames."""
