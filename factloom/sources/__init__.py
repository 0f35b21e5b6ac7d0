"""Readers, writers and namespaces of sources."""
