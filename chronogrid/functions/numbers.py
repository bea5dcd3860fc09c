"""Numbers as the records hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into halves of 26 bits, whose products with a small number are exact.
SPLIT = 134217729.0
#: From here on a double has no fraction.
WHOLE = 9007199254740992.0
#: From here on it has no halves.
HALVES = 4503599627370496.0


def exact_round(c: Column, places: int) -> Column:
    """The double nearest to c rounded to places (0 to 7) by its exact value, ties to even.

    Rounding the decimal text of a double, as ``round`` does, gives 2.68 for 2.675, which is a
    little less than that; here it is 2.67. The product with the power of ten is split into
    its double and what that lost, and only where the double is just halfway the loss decides.
    Nulls stay, as do NaN, infinities and values too large to have such places.
    """
    if not 0 <= places <= 7:
        raise ValueError("0 to 7 places")
    power = float(10**places)
    x = F.abs(c.cast("double"))
    product = x * power
    high = x * SPLIT - (x * SPLIT - x)
    lost = (high * power - product) + (x - high) * power
    low = F.floor(product).cast("double")
    over = product - (low + 0.5)
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (low % 2 == 1))))
    tied = (F.abs(lost) == 0.5) & (low % 2 == 1)  # from HALVES on the product is whole and only what it lost has a half
    step = F.when(product >= HALVES, F.when(tied, F.signum(lost)).otherwise(0.0)).otherwise(F.when(up, 1.0).otherwise(0.0))
    rounded = (low + step) / power
    return F.when(product < WHOLE, F.when(c < 0, -rounded).otherwise(rounded)).otherwise(c.cast("double"))
