"""Decisions and their evaluation: costs, bands, metrics, splits, scoring, explanation."""
