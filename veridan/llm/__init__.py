"""Corpus operators for training-data pipelines, each one a Spark job over whole tables."""
