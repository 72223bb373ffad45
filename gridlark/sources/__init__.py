"""Readers and writers of gridded data."""
