"""Runnable queries over the given tables, with their SQL counterparts."""

from importlib import import_module

MODULES = (
    "calendar_queries",
    "series_queries",
    "source_queries",
    "selection_queries",
    "aggregate_queries",
    "merge_queries",
    "model_queries",
    "stream_queries",
)


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
