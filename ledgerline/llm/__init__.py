"""Operators for large-scale training-data preparation on Spark.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
