"""Operators over pixel and chunk tables."""
