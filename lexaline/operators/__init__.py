"""Relational and corpus-level operators on DataFrames."""
