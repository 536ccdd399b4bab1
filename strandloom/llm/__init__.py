"""Operators for large training-data pipelines.

Nothing outside this folder (besides ``corpus_pipeline.py`` and ``tests/llm``)
imports it.
"""
