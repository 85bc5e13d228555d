"""Operators on tables: cleaning, captures, manifest, history, discovery, integrity."""
