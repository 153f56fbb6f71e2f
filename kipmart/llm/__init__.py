"""Operators for building language-model training data on Spark.

Nothing else in the library imports this subpackage; its queries are in
:mod:`kipmart.llm.queries`, the pipeline in ``corpus_pipeline.py``.
"""
