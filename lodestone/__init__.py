"""Repository-audit and text-corpus analytics as Spark DataFrames."""
