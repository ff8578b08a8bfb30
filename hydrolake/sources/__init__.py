"""Readers, writers and the relations derived from the star-schema tables."""
