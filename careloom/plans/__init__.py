"""Registered queries over the order, event and document tables."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of queries so that they register themselves."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
