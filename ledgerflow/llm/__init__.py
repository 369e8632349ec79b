"""Operators of a training-data pipeline, and their registered queries.

One module per operator; ``queries.py`` binds them to the test tables and
holds the SQL of those that SQL can express. Nothing outside this folder
(and ``corpus_pipeline.py``) imports it.
"""
