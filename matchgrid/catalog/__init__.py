"""Runnable queries over the driver tables, one per operator."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every ``q_*`` module, which registers its queries."""
    for m in iter_modules(__path__):
        if m.name.startswith("q_"):
            import_module(f"{__name__}.{m.name}")
