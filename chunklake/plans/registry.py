"""Named queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from chunklake.plans import filesystem, ingestion, listing, policies, scalars, states, storage
from chunklake.plans.prelude import with_

_ALL = {**storage.QUERIES, **ingestion.QUERIES, **listing.QUERIES, **filesystem.QUERIES, **policies.QUERIES, **scalars.QUERIES, **states.QUERIES}


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_(sql) for name, (_, sql) in _ALL.items() if sql}
