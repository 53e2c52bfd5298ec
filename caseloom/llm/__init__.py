"""Corpus preparation for language-model training data, each step a Spark job.

Nothing else in the library imports this subpackage; the entry module adds its
queries only where it can be imported.
"""
