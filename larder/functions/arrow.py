"""Arrow functions that are made when they are called.

Making one parses its type, which needs a session; workers import these modules without one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(sql: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.arrow_udf(f, sql)(*columns)

        call.function = lambda: F.arrow_udf(f, sql)  # to be registered under an SQL name
        return call

    return wrap
