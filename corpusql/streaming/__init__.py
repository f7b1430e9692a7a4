"""Structured Streaming variants of the evaluation metrics."""
