"""Registry of the record pipeline's queries and their SQL counterparts."""

from __future__ import annotations

from voxloom.plans import catalog_batches, catalog_chat, catalog_eval, catalog_frames, catalog_rows, catalog_sources, catalog_streams, catalog_tokens  # noqa: F401
from voxloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
