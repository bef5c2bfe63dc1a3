"""A document-retrieval and corpus-processing engine on Spark DataFrames."""
