"""Readers and writers of the report tables."""
