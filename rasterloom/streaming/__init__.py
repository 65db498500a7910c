"""Streams of tiles."""
