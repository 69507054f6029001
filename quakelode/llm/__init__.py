"""Operators for large text and embedding corpora; nothing outside this subpackage imports it."""
