"""Registered queries by area."""
