"""Registered queries, the input views they derive from the given tables, and their oracles."""
