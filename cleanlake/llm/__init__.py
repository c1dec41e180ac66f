"""Operators of a training-data pipeline. Nothing outside this folder, `corpus_pipeline.py` and `__spark_entry__.py` imports it."""
