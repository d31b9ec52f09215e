"""Queries over the driver tables and their oracles."""
