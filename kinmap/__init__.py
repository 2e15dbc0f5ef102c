"""kinmap: similarity search, vote ranking and provenance graphs as Spark DataFrames."""
