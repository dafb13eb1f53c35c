"""Randomized checks of the session, funnel and order rules against plain Python."""

import random
from collections import defaultdict

from funnelworks.operators.orders import orders
from funnelworks.operators.sessions import session_funnel, sessions
from funnelworks.operators.staging import stage_events
from helpers import ev, raw_df

NAMES = ["view_item", "add_to_cart", "begin_checkout", "purchase", "page_view", "view_search_results", None]
STEPS = ["view_item", "add_to_cart", "begin_checkout", "purchase"]


def _random_events(seed=7, n_sessions=300):
    rnd = random.Random(seed)
    rows, meta = [], []
    for s in range(n_sessions):
        user = f"u{rnd.randint(0, 60)}"
        sid = s
        for _ in range(rnd.randint(1, 9)):
            name = rnd.choice(NAMES)
            sec = rnd.randint(0, 6)                               # small range: many ties
            txn = ecom = usd = rev = None
            if name == "purchase":
                key = f"T{rnd.randint(0, 40)}"                     # shared keys: duplicates across sessions
                ecom = key if rnd.random() < 0.6 else None
                txn = key if rnd.random() < 0.6 else None
                usd = rnd.choice([None, round(rnd.random() * 90, 2)])
                rev = rnd.choice([None, round(rnd.random() * 90, 2)])
            rows.append(ev(name, user, sec, sid=sid, txn=txn, ecom_txn=ecom, usd=usd, rev=rev,
                           device=rnd.choice(["desktop", "mobile", None])))
            meta.append((f"{user}-{sid}", user, name, sec, txn, ecom, usd, rev))
    return rows, meta


def test_funnel_and_sessions_match_brute_force(spark):
    rows, meta = _random_events()
    stg = stage_events(raw_df(spark, rows))
    by_session = defaultdict(list)
    for m in meta:
        by_session[m[0]].append(m)

    got_f = {r.session_key: r for r in session_funnel(stg).collect()}
    got_s = {r.session_key: r for r in sessions(stg).collect()}
    assert set(got_f) == set(got_s) == set(by_session)
    for key, evs in by_session.items():
        first = {s: min((e[3] for e in evs if e[2] == s), default=None) for s in STEPS}
        reached, ok, prev = [], True, None
        for s in STEPS:
            t = first[s]
            ok = ok and t is not None and (prev is None or t >= prev)
            reached.append(ok)
            prev = t
        f = got_f[key]
        assert [f.reached_view_item, f.reached_add_to_cart_after_view, f.reached_begin_checkout_after_cart,
                f.reached_purchase_after_checkout] == reached, key
        s = got_s[key]
        assert s.event_count == len(evs)
        assert s.has_purchase == any(e[2] == "purchase" for e in evs)
        assert s.has_search == any(e[2] == "view_search_results" for e in evs)
        keys = {e[5] if e[5] is not None else e[4] for e in evs if e[2] == "purchase"} - {None}
        assert s.transaction_count == len(keys), key
        usd = [e[6] for e in evs if e[2] == "purchase" and e[6] is not None]
        assert abs(s.session_revenue_usd - round(sum(usd), 6)) < 1e-9


def test_orders_match_brute_force(spark):
    rows, meta = _random_events(seed=11)
    got = {r.order_transaction_key: r for r in orders(stage_events(raw_df(spark, rows))).collect()}
    want = {}
    for m in meta:
        if m[2] != "purchase":
            continue
        key = m[5] if m[5] is not None else m[4]
        if key is None:
            continue
        rev = m[6] if m[6] is not None else (m[7] if m[7] is not None else 0.0)
        if key not in want or m[3] < want[key][0]:
            want[key] = (m[3], [rev])
        elif m[3] == want[key][0]:
            want[key][1].append(rev)                             # tie at the earliest time
    assert set(got) == set(want)
    for key, (_, revs) in want.items():
        assert got[key].order_revenue_usd in revs
