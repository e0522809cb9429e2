"""Scoring of instances as they arrive."""
