"""Arrow functions that may be defined before there is a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def arrow_function(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A decorator: Arrow arrays in, an Arrow array of type ``kind`` out; called with columns."""

    def decorate(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return arrow_udf(f, kind)(*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return decorate
