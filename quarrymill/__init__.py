"""A document retrieval and grounding engine on Spark DataFrames."""
