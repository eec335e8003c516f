"""Corpora, result files, caches and completion providers."""
