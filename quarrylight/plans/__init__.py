"""The registered queries over the fixture tables, each with its DuckDB counterpart."""

from __future__ import annotations

from quarrylight.plans import file_queries as _files  # noqa: F401
from quarrylight.plans import queries as _queries  # noqa: F401
from quarrylight.plans import scale_queries as _scale  # noqa: F401
from quarrylight.plans import text_queries as _text  # noqa: F401
from quarrylight.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
