"""Compositions of operators: whole queries and the query catalogue."""
