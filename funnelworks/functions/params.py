"""Nested event-parameter access (EXP-1, EXP-2, EXP-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_TYPES = ("string_value", "int_value", "double_value", "float_value")


def event_param(key: str, value_type: str, params: str | Column = "event_params") -> Column:
    """Typed value of the first parameter named ``key``; NULL when absent.

    ``array_position`` over the array of keys finds the first match (0 when
    absent) and ``get`` reads that element, NULL when out of bounds (it does
    not raise under ANSI mode, unlike ``[i]``). No explode, no join, and no
    lambda: the lookup compiles into the scan's whole-stage code.
    """
    if value_type not in VALUE_TYPES:
        raise ValueError(f"value_type must be one of {VALUE_TYPES}, got {value_type!r}")
    arr = F.col(params) if isinstance(params, str) else params
    pos = F.array_position(arr.getField("key"), F.lit(key))
    return F.get(arr, (pos - 1).cast("int"))["value"][value_type]


def event_param_sql(key: str, value_type: str, params: str = "event_params") -> str:
    """``event_param`` as Spark SQL text (one expression string, same semantics)."""
    if value_type not in VALUE_TYPES:
        raise ValueError(f"value_type must be one of {VALUE_TYPES}, got {value_type!r}")
    k = key.replace("'", "\\'")
    return f"get({params}, CAST(array_position({params}.key, '{k}') - 1 AS INT)).value.{value_type}"


def session_key(user: str | Column, session_id: str | Column) -> Column:
    """``user || '-' || session_id``; NULL when either side is NULL."""
    u = F.col(user) if isinstance(user, str) else user
    s = F.col(session_id) if isinstance(session_id, str) else session_id
    return F.when(s.isNotNull(), F.concat(u, F.lit("-"), s.cast("string")))
