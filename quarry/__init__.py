"""Exact search, statistics and contamination studies over text corpora on Spark."""
