"""Relational operators of change-impact analysis."""
