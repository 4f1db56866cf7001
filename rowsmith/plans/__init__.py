"""Shared plan shapes: skew-safe joins, durable cuts, registered queries."""

from importlib import import_module
from pkgutil import iter_modules


def load_queries() -> None:
    """Import every ``q_*`` module, which registers its queries."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
