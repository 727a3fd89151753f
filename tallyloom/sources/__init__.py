"""Readers and schema checks."""
