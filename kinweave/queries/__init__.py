"""Every runnable query, by section."""

import importlib

from kinweave.queries.registry import QUERIES, SQL

SECTIONS = ["contracts", "cleaning", "identity", "edges", "panel", "transforms", "modelling", "trials", "storage", "incremental"]

for _section in SECTIONS:
    importlib.import_module(f"kinweave.queries.{_section}")

__all__ = ["QUERIES", "SQL"]
