"""Statements of definitions in SQL, for checking results."""
