"""Registered queries; `load_all` imports every plan module once."""

from importlib import import_module

MODULES = (
    "text_plans", "browse_plans", "join_plans", "series_plans", "vector_plans", "graph_plans", "quality_plans",
    "entity_plans",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"missiva.plans.{name}")
