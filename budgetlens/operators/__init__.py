"""Retrieval, coverage, metrics and decisions as DataFrame operators."""
