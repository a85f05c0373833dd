"""A text-language and corpus engine on Spark DataFrames."""
