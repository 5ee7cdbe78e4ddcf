"""Compositions: fixtures over the given tables, pipelines and the query catalogue."""
