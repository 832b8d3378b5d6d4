"""All registered queries with their SQL."""

from __future__ import annotations

from recollect.plans import session_queries, store_queries, stream_queries, text_queries

MODULES = (text_queries, store_queries, session_queries, stream_queries)


def registered() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found
