"""Queries over the driver tables, one per operator, each with a SQL twin where SQL can express it."""

from importlib import import_module

MODULES = (
    "indicator_queries",
    "strategy_queries",
    "structure_queries",
    "join_queries",
    "range_queries",
    "scalar_queries",
    "source_queries",
    "text_queries",
    "stream_queries",
    "dense_queries",
)


def load_catalog() -> None:
    """Import every query module once; importing registers its queries."""
    for module in MODULES:
        import_module(f"tickloom.catalog.{module}")
