"""Operators of the record-to-journey engine."""
