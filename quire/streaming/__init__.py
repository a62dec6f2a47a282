"""Streams of the layout engine."""
