"""Operators over tables: parsing, spans, forests, search, corpora."""
