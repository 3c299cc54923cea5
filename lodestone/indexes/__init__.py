"""Stored indexes for search: posting lists of words and of trigrams, and cells of vectors."""
