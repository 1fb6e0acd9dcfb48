"""Compositions of operators: the report, the weekly run, the query catalog."""
