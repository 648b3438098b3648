"""Readers and writers of text, delimited and index formats."""
