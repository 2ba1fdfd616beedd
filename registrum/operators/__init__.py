"""Relational operators of the register pipeline: each takes and returns DataFrames."""
