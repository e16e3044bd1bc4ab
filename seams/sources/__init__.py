"""Readers of source trees, version history, traces, documents and labels."""
