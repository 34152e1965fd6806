"""Landed payload parsers and writers."""
