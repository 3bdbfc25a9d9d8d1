"""Readers of exports and landed feed files, and the table contracts."""
