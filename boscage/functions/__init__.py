"""Predicates over nodes and functions over text."""
