"""Readers, writers, schemas and fixed dimension tables."""
