"""Operators for preparing training text at scale.

Nothing outside this folder (but ``corpus_pipeline.py``) imports it.  Every operator takes a
DataFrame and returns one; the registered ``opN_`` queries in :mod:`moraine.llm.queries` are thin.
"""
