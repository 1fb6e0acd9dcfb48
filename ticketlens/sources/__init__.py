"""Readers, writers and the derived ticket table."""
