"""Streaming counterparts of the as-of features."""
