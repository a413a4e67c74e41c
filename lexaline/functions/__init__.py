"""Column functions: text normalisation, matching, statistics."""
