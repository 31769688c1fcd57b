"""Incremental models and drift."""
