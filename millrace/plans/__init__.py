"""Registered queries over the given tables."""

from importlib import import_module

_FAMILIES = ("scoring", "group_stats", "corpus", "fields", "indexing", "chat", "masks", "token_logs", "run_logs", "live", "curation")


def load_all() -> None:
    for name in _FAMILIES:
        import_module(f"millrace.plans.{name}")
