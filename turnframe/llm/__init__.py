"""Operators for preparing text corpora at scale; nothing else in turnframe imports this package."""
