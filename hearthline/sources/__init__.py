"""Readers of raw inputs and writers of results."""
