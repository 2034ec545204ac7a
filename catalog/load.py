"""Importing this module registers every query."""

from catalog import basics, decisions, fairness, impact, layers, mapping, overview, performance, sketches, timeuse  # noqa: F401
