"""Readers, writers and dataset construction."""
