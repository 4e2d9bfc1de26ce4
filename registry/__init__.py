"""Registered queries, each with the SQL its result is checked against."""

import importlib

SECTIONS = [
    "scenes", "projections", "joins", "geometry", "vegetation", "stats", "wildlife", "sources", "signal", "learning",
    "products", "streams",
]


def load():
    """All queries and oracles, registered on import of the sections."""
    for section in SECTIONS:
        importlib.import_module(f"registry.{section}")
    from registry.core import ORACLES, QUERIES

    return QUERIES, ORACLES
