"""Queries: the operators applied to the standard tables, each with its SQL."""
