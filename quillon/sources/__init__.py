"""Readers of landed files and writers of results; the engine itself fetches nothing."""
