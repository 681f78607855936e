"""Operators for building language-model training data.

Nothing outside this folder imports it: the folder, its tests and
``corpus_pipeline.py`` can be deleted without touching the rest.
"""
