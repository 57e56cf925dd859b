"""Document-to-order analytics on Spark DataFrames."""
