"""Queries over streams of sources."""
