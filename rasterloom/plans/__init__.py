"""Registered queries and end-to-end plans."""
