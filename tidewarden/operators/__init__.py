"""Batch operators over event tables."""
