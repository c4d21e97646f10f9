"""Readers: file trees, and extractors that turn file texts into rows."""
