"""Relevance analytics on Spark."""
