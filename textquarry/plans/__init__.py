"""Multi-step plans: index runs, the vector table build and the registered queries."""

from __future__ import annotations

from importlib import import_module


def load_queries() -> None:
    """Import the modules that register queries."""
    for name in ("text_queries", "file_queries", "vector_queries", "index_queries"):
        import_module(f"{__name__}.{name}")
