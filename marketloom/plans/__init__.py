"""Registered queries by area."""

from importlib import import_module

AREAS = ("text_queries", "price_queries", "event_queries")


def load() -> None:
    for area in AREAS:
        import_module(f"marketloom.plans.{area}")
