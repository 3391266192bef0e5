"""Readers of cadastral files."""
