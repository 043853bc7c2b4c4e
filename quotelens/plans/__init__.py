"""Queries over the driver tables: every operator on whole tables, with check SQL where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module once; returns (queries, checks)."""
    from quotelens.plans import registry

    for mod in pkgutil.iter_modules(__path__):
        if mod.name not in ("registry", "evidence"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return registry.QUERIES, registry.CHECKS
