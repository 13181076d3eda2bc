"""The named queries: each a plan over the tables of a folder, with SQL for the oracle where SQL can express it."""

from __future__ import annotations

from . import catalog, cloud, content, files, metadata, pii, streams, tables
from ._common import Query

_MODULES = (pii, tables, catalog, cloud, files, content, metadata, streams)


def queries() -> dict[str, Query]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
