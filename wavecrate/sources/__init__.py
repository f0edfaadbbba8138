"""Readers and writers of the formats that catalogs arrive in."""
