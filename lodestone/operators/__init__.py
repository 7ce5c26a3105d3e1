"""Relational operators around audit rules."""
