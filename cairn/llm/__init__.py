"""Operators that prepare text corpora for training language models.

Nothing outside this subpackage imports it, apart from the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``, which counts as part of it.
"""
