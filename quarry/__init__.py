"""Evidence retrieval and analytics on Spark DataFrames."""
