"""Version-history analytics as plain Spark DataFrames."""
