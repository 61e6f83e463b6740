"""Training-data operators. Nothing outside this package, corpus_pipeline.py and the query registry imports it."""
