"""Message forensics and corpus analytics on Spark DataFrames."""
