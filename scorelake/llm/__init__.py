"""Operators of a training-data pipeline and the queries that apply them.

``queries.QUERIES`` / ``queries.ORACLE`` hold what ``__spark_entry__`` adds.
Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
