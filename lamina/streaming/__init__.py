"""Extraction that goes on as archives arrive."""
