"""Readers, writers and column resolution."""
