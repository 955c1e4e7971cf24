"""Readers for the tables the operators work on."""

from cairnstat.sources.tables import table  # noqa: F401
