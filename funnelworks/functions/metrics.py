"""Scalar and aggregate helpers (EXP-10..14, AGG-3..5, WIN-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed as a decimal with six places (amounts are rounded half up to a millionth) and then
# turned back into a double: the total does not depend on the order rows arrive in a shuffle, and it
# may have 32 digits before the point.
MONEY_INPUT, MONEY = "decimal(32,6)", "decimal(38,6)"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b as double; NULL when b is 0 or either side is NULL."""
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def money(x: str | Column) -> Column:
    """A currency column as the decimal that is summed."""
    return _c(x).cast(MONEY_INPUT)


def money_sum(x: str | Column) -> Column:
    """Order-independent sum of a currency column, as double (NULL for no values)."""
    return F.sum(money(x)).cast("double")


def any_flag(cond: Column) -> Column:
    """``max(case when cond then 1 else 0 end) = 1``: never NULL."""
    return F.coalesce(F.bool_or(F.coalesce(cond, F.lit(False))), F.lit(False))


def count_when(cond: Column) -> Column:
    """Number of rows where cond is true (NULL counts as false; 0 without rows)."""
    return F.count_if(cond)


def week_start(d: str | Column) -> Column:
    """Monday of the week containing date d, as DATE."""
    return F.date_trunc("week", _c(d)).cast("date")


def weeks_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole weeks between two Mondays, as bigint."""
    return F.floor(F.datediff(_c(later), _c(earlier)) / F.lit(7)).cast("long")


def first_by_time(order_cols: list[str | Column], value_cols: list[str]) -> Column:
    """Struct of ``value_cols`` taken from the row with the smallest ordering.

    ``min`` over a struct compares field by field (NULLs first), so the
    leading order columns choose the row and the value columns themselves
    break any remaining tie deterministically. Partial aggregation applies,
    so a hot key is combined map-side before the shuffle.
    """
    fields = [_c(c) for c in order_cols] + [F.col(c) for c in value_cols]
    names = [f"_o{i}" for i in range(len(order_cols))] + list(value_cols)
    return F.min(F.struct(*[f.alias(n) for f, n in zip(fields, names)]))
