"""Address search and enrichment on Spark DataFrames."""
