"""Evidence, recall and corpus preparation jobs written with Spark DataFrames."""
