"""Readers, writers and dictionary files."""
