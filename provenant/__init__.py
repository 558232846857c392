"""Extraction quality and record history on Spark."""
