"""Readers, writers and the tables derived from the driver's test data."""
