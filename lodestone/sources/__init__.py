"""Readers of repository snapshots."""
