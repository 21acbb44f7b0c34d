"""The registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import REGISTRY, Query


def load_all() -> dict[str, Query]:
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")
    importlib.import_module(f"{__name__}.split_plans").add_twins()
    return REGISTRY
