"""Schemas, file readers / writers and test-data views."""
