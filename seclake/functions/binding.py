"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it.

    Inside a lambda the optimizer shares nothing, so a value used twice would be computed twice, or
    once per element of an inner array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
