"""Registries, runs, experiment grids and the registered queries."""
