"""Relational operators over feeds: each takes and returns DataFrames."""
