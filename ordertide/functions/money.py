"""Money sums that do not depend on how rows are partitioned.

Adding doubles gives different last bits for different partitionings, which then flips half-cent
roundings. Amounts are therefore added as decimals. A price becomes a decimal from its shortest
decimal text, so 123.45 is exactly 123.45, and quantity * price is exact as well. No digit is ever
dropped: an amount that a decimal does not hold exactly (a price with more digits, NaN, infinities)
goes into a separate double sum and reaches the result the way plain double arithmetic carries it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_TYPE = "decimal(20,8)"
ORDER_AMOUNT_TYPE = "decimal(23,8)"
AMOUNT_TYPE = "decimal(38,8)"


def _exactly(value: Column, kind: str) -> Column:
    """``value`` as a decimal; NULL unless the decimal is the same double again."""
    held = value.try_cast(kind)
    return F.when(held.cast("double") == value, held)


def exact_amount(quantity: Column, price: Column) -> Column:
    """quantity * price as a decimal; NULL if either is NULL or a decimal does not hold the amount."""
    product = quantity.cast("decimal(10,0)") * _exactly(price, PRICE_TYPE)
    return product.try_cast(ORDER_AMOUNT_TYPE).cast(AMOUNT_TYPE)


def stray_amount(quantity: Column, price: Column) -> Column:
    """quantity * price as a double, only where ``exact_amount`` cannot hold it."""
    return F.when(exact_amount(quantity, price).isNull(), quantity * price)


def rounded_total(exact: Column, stray: Column) -> Column:
    """Total of an exact part and a stray part as a double with two places, HALF_UP."""
    plain = F.round(exact, 2).cast("double")
    mixed = F.round(F.coalesce(exact.cast("double"), F.lit(0.0)) + stray, 2)
    return F.when(stray.isNull(), plain).otherwise(mixed)


def rounded_mean(exact: Column, stray: Column, n: Column) -> Column:
    """Mean over ``n`` amounts, two places, HALF_UP.

    Decimal division would round to eight places first and then again to two. The integral
    division below finds floor(mean / 0.01 + 1/2) in one exact step.
    """
    half_up = exact.cast("decimal(34,8)") * F.lit(2) + n * F.expr("0.01BD")
    cents = F.call_function("div", half_up, n * F.expr("0.02BD"))
    mixed = F.round((F.coalesce(exact.cast("double"), F.lit(0.0)) + stray) / n, 2)
    return F.when(n > 0, F.when(stray.isNull(), cents / F.lit(100.0)).otherwise(mixed))


def exact_sum(value: Column, factor: Column) -> Column:
    """Aggregate: sum of value * factor (a whole number) over the values that a decimal holds; 0 if there are none."""
    held = _exactly(value, "decimal(28,8)")
    return F.coalesce(F.sum((held * factor).cast(AMOUNT_TYPE)), F.lit(0)).cast(AMOUNT_TYPE)


def stray_sum(value: Column, factor: Column) -> Column:
    """Aggregate: sum of value * factor over the other values, as a double; NULL if there are none."""
    held = _exactly(value, "decimal(28,8)")
    return F.sum(F.when(held.isNull(), value * factor))


def joined_sum(exact: Column, stray: Column) -> Column:
    """The sum that `exact_sum` and `stray_sum` are the parts of, as a double."""
    plain = exact.cast("double")
    return F.when(stray.isNull(), plain).otherwise(plain + stray)


def total(value: Column) -> Column:
    """Aggregate: order-independent sum of a double column, as a double; NULL if all are NULL."""
    held = _exactly(value, "decimal(28,8)")
    exact = F.sum(held)
    stray = F.sum(F.when(held.isNull(), value))
    mixed = F.coalesce(exact.cast("double"), F.lit(0.0)) + stray
    return F.when(stray.isNull(), exact.cast("double")).otherwise(mixed)
