"""Document-outline analytics on Spark: every operator takes and gives DataFrames keyed by ``doc_id``."""
