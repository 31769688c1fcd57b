"""Operators on tables of points."""
