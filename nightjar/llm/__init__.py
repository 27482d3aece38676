"""Operators for preparing language-model training corpora.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only when it is present.
"""
