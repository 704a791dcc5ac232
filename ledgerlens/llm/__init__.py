"""Operators for large-scale training-data pipelines.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports
it.  ``ledgerlens.llm.queries`` holds the registered queries and their SQL.
"""
