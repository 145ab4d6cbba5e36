"""Declared schemas, scans, sinks and dataset layout."""
