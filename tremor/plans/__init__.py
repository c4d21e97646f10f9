"""Whole queries: the impact report over change-sets, and what is written of it."""
