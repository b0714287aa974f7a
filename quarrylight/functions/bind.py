"""Small helpers for expressions over arrays."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often lambdas in the body name it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def constants(rows: Sequence[dict], kind: str) -> Column:
    """A constant array of structs ``kind``: one folded value, where an expression for each row would outgrow generated code."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{kind}>>")
