"""Prepared plans over the tables of the test data, and their SQL."""
