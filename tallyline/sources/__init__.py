"""Readers, feeds and writers."""
