"""Code-repository analytics as Spark DataFrames."""
