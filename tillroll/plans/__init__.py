"""Whole pipelines and the query registry."""
