"""Lexicons, weights, thresholds, patterns and lookup tables."""
