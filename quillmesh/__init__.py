"""A knowledge-graph and text-corpus engine on Spark DataFrames."""
