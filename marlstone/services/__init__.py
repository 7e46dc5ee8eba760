"""Catalog views and a registry of submitted statements."""
