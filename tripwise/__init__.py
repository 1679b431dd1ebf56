"""Demand analytics on trip data, written as plain Spark DataFrame transformations."""
