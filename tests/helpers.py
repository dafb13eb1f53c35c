"""Hand-written raw events for edge-case tests."""

import datetime as dt

from funnelworks.sources.schema import RAW_EVENT

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def ev(name, user, sec, sid=1, day="20240101", txn=None, ecom_txn=None, usd=None, rev=None, device="mobile",
       medium="organic", items=None, page="/p/1", extra_params=()):
    params = []
    if sid is not None:
        params.append(("ga_session_id", (None, sid, None, None)))
    if page is not None:
        params.append(("page_location", (page, None, None, None)))
    if txn is not None:
        params.append(("transaction_id", (txn, None, None, None)))
    params.extend(extra_params)
    d = dt.datetime.strptime(day, "%Y%m%d").replace(tzinfo=dt.timezone.utc)
    micros = int((d - BASE).total_seconds() * 1e6) + int(BASE.timestamp() * 1e6) + int(sec * 1e6)
    return (day, micros, name, user, params, (rev, usd, ecom_txn, None),
            (device, "os", ("br",)), ("C", "T", "K", "S"), ("src", medium, "cmp"), items)


def item(item_id, price=10.0, qty=1, rev_usd=None, name="n"):
    return (item_id, name, "b", "c", None, None, price, price, qty, None, rev_usd)


def raw_df(spark, rows):
    return spark.createDataFrame(rows, RAW_EVENT)
