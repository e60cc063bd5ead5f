"""Operators over samples, edges, layouts and frames; each takes and returns DataFrames."""
