"""Scans and sinks: datasets, artifacts, governance tables, benchmark files."""
