"""Scans, sinks and the stand-in views built from the driver tables."""
