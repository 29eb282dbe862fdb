"""Queries over the shared tables, each next to the SQL that checks it."""
