"""Find, explain and review anomalous business records with Spark DataFrames."""
