"""Composite queries and the registry of checked queries."""
