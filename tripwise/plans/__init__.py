"""Composite plans: raw files to clean tables, to features, to models and reports."""
