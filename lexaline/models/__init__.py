"""Regression, ordinal and ensemble models."""
