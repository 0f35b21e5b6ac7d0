"""Operators over fact, chunk and vector tables."""
