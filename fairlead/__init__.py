"""Fairlead: listing discovery, matching and trust analytics as Spark jobs."""
