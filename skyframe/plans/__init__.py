"""Composite jobs: each takes DataFrames and returns DataFrames."""
