"""Grammars as compiled plans: reading, analysis, lexing and the per-message parse."""
