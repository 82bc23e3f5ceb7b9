"""Operators that prepare text corpora for language-model training.

Nothing else in the package imports this folder; its queries are in
``queries.py`` and are added by the entry module.
"""
