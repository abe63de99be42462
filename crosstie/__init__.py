"""Cross-entity tie-out of international tax returns on Spark DataFrames."""
