"""Readers for feeds, CSV and JSON files, object listings and tables."""
