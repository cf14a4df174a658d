"""Named queries of the engine and the SQL that checks them."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLE: dict = {}


def register(name, sql=None):
    """Decorator: adds (spark, sf_dir) -> DataFrame under `name`, with its oracle SQL."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return add


def _load():
    import importlib

    for module in ("text", "search", "taxonomy", "temporal", "graph", "pairs", "quality", "evaluate", "ingest", "streams"):
        importlib.import_module(f"lodestrata.plans.{module}_queries")


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_ORACLE)
