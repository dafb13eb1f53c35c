"""Column expressions shared by the models (EXP-*)."""

from funnelworks.functions.params import event_param, session_key
from funnelworks.functions.metrics import (
    safe_divide, money_sum, any_flag, week_start, weeks_between, count_when, first_by_time,
)

__all__ = [
    "event_param", "session_key", "safe_divide", "money_sum", "any_flag", "week_start",
    "weeks_between", "count_when", "first_by_time",
]
