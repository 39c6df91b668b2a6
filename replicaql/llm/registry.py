"""All corpus queries and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("katz", "anisotropic", "mixing", "neighbours", "line_chunks", "partenum", "licenses", "host_rules", "pieces", "toxicity", "collisions", "whitening", "filter_audit")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(import_module(f"{__package__}.{m}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
