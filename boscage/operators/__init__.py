"""Operators over trees, sections and text: call graph, search, rewriting, views."""
