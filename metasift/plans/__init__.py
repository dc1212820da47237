"""Registered queries. The sources' are added to the others' tables when either module is imported."""

from metasift.plans import queries, sources

__all__ = ["queries", "sources"]
