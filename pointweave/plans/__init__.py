"""Histories of tables, and the queries that show each operator."""
