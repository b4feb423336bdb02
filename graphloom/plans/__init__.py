"""Composite plans, the maintenance pass and the registered queries."""
