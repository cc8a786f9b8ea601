"""Readers, writers and the catalog of tables."""
