"""Incremental versions of the feed and discovery jobs."""
