"""Operators over question-and-passage text corpora, as Spark DataFrame transformations."""
