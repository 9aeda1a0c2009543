"""Queries, their SQL, and reports."""
