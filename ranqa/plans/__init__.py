"""Named query plans over the driver tables and their SQL oracles."""

from __future__ import annotations


def all_queries():
    """Import every query module (registration happens on import) and return the registry."""
    from ranqa.plans import q_rerank  # noqa: F401
    from ranqa.plans.registry import REGISTRY

    for mod in ("q_corpus", "q_text", "q_retrieval"):
        try:
            __import__(f"ranqa.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"ranqa.plans.{mod}":
                raise
    return REGISTRY
