"""Operators for preparing language-model training corpora.

Thirteen stand-alone DataFrame operators.  Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it.
"""
