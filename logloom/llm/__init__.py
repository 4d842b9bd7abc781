"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``queries`` binds the operators to the
driver's tables; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
