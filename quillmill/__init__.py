"""Literature and document-corpus analytics on Spark DataFrames."""
