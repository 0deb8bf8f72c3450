"""All registered queries and their SQL, gathered from the topic modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bars", "indicators", "rules", "signals", "ensembles", "options", "facts", "retrieval",
           "filings", "answers", "chat", "streams")


def _gather(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        module = import_module(f"brasstide.plans.{name}_queries")
        for key, value in getattr(module, kind).items():
            assert key not in out, key
            out[key] = value
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
