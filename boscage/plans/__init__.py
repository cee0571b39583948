"""Selectors and chains: plans as data, and their compilation to DataFrames."""
