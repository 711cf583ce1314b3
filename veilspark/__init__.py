"""Sensitive-data detection and redaction on Spark DataFrames."""
