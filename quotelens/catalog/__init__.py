"""All registered queries, grouped by the kind of work they do."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "expressions", "pointintime", "audits", "statistics", "modeling", "learning")


def load():
    """(queries, SQL) over every catalog module."""
    for module in MODULES:
        import_module(f"quotelens.catalog.{module}")
    from quotelens.catalog import base

    return dict(base.QUERIES), dict(base.ORACLES)
