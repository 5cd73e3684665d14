"""Weir: URL-collection analytics as lazy Spark plans."""
