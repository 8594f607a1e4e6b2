"""Streaming faces of the bar operators."""
