"""Knowledge, learning and corpus analytics on Spark DataFrames."""
