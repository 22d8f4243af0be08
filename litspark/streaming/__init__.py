"""Arriving papers."""
