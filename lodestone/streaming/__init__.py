"""Streaming feeds of findings."""
