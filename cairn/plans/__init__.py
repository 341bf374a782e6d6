"""Cairn plans."""
