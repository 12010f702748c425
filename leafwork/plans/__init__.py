"""Named queries and their SQL."""

from __future__ import annotations

from leafwork.plans import citing, events, forms, index, layout, pages, records, references, verses

_PARTS = (references, pages, layout, records, citing, verses, forms, index, events)


def all_queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
