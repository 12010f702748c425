"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("alike_queries", "listing_queries", "people_queries", "matching_queries", "quality_queries", "scan_queries", "packing_queries")


def _parts():
    return [import_module(f"leafwork.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {k: v for part in _parts() for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _parts() for k, v in part.SQL.items()}
