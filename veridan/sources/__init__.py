"""Readers, writers and the adapter from order tables to the risk schemas."""
