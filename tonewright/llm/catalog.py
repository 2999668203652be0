"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("variants", "lookalike", "format_dedup", "mojibake", "survivor", "truncation", "canonical", "packing", "leakage", "sentences")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").SQL
    return out
