"""Incremental arrival of yearly files."""
