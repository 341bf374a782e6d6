"""Cairn sources."""
