"""Structured Streaming forms of the history operators (ST1-ST4)."""
