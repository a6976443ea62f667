"""Streams of new queries against a stored index."""
