"""Schemas, readers, writers and the database registry."""
