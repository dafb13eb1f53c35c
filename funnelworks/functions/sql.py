"""SQL-text forms of the metric helpers, for models written as expression strings.

Each builds exactly the expression of its Column twin in ``metrics.py``
(same casts, same literal types), so both give identical values. A model
written with these costs one driver->JVM call per output column instead of
one per function node, which keeps plan construction cheap.
"""

from __future__ import annotations

from funnelworks.functions.metrics import MONEY_INPUT


def money_sum(x: str) -> str:
    return f"CAST(sum(CAST(({x}) AS {MONEY_INPUT})) AS DOUBLE)"


def safe_divide(a: str, b: str) -> str:
    return f"try_divide(CAST(({a}) AS DOUBLE), nullif(CAST(({b}) AS DOUBLE), CAST(0 AS DOUBLE)))"


def any_flag(cond: str) -> str:
    return f"coalesce(bool_or(coalesce(({cond}), false)), false)"


def count_when(cond: str) -> str:
    return f"count_if({cond})"


def first_by(order_cols: list[str], value_cols: list[str]) -> str:
    """``min`` over a struct led by the ordering columns (see ``metrics.first_by_time``)."""
    fields = [f"'_o{i}', {c}" for i, c in enumerate(order_cols)] + [f"'{c}', {c}" for c in value_cols]
    return f"min(named_struct({', '.join(fields)}))"


def aliased(pairs: list[tuple[str, str]]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in pairs]
