"""Structured-extraction data work on Spark: generate, corrupt, recover, validate, score, compare."""
