"""Registered queries and the SQL that says the same on another engine."""
