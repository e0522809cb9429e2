"""Scans and sinks of the file formats, with explicit schemas."""
