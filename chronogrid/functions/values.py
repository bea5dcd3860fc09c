"""Values that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once a row however often f names it.

    A column that is named twice is computed twice within a lambda, and what stands in a
    lambda is computed for each element, so nested uses multiply; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
