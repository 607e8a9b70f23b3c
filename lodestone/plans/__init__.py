"""Queries by name, each with the SQL it is compared with."""
