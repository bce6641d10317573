"""Registered queries by area."""

from importlib import import_module

from listenlake.plans.registry import ORACLES, QUERIES

AREAS = ["dashboard", "catalogue", "playlists", "sessions", "ingest", "http", "search", "live"]


def _load() -> None:
    for area in AREAS:
        import_module(f"listenlake.plans.{area}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
