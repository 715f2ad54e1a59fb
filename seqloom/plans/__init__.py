"""Registered queries: Spark plans and the SQL they are compared with."""

from __future__ import annotations

import importlib

FAMILIES = ("general", "assignment", "genome", "sequence", "aligning", "formats")


def _merged(what: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out |= getattr(importlib.import_module(f"seqloom.plans.{family}"), what)()
    return out


def all_queries() -> dict:
    return _merged("queries")


def all_sql() -> dict[str, str]:
    return _merged("oracle_sql")
