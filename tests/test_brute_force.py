"""Sequence operators against plain Python on random events, with one device that sends a third of them."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.enrich.payload import suppress_rapid
from tidemark.functions.timeutil import Period
from tidemark.operators.features import features
from tidemark.operators.funnel import conversion_series, funnel_levels
from tidemark.operators.journey import distinct_prefix
from tidemark.operators.sessions import sessionize, sessions

START = datetime(2024, 1, 1)
PERIOD = Period(START, START + timedelta(days=10))
DDL = ("id bigint, tenant_id int, shop_id int, device_id string, name string, path string, product_id int, revenue bigint, revenue_usd bigint, currency string, customer_id string, origin string, referrer string, "
       "referrer_name string, referrer_type string, os string, browser string, device string, country string, city string, created_at timestamp_ntz")


def sample(seed, n=400, step=1800, unit=1.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        device = "hot" if i % 3 == 0 else f"d{rng.randrange(8)}"
        at = START + timedelta(seconds=rng.randrange(0, n * step // 40) * unit)
        rows.append((i, 1, 1, device, rng.choice("abcx"), rng.choice(["", "/1", "/2", "/3", "/4"]), rng.randrange(5), 100, 100, "USD", None, "", "", "", "", "", "", "", "", "", at))
    return rows


def by_device(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[-1], r[0])):
        out.setdefault(r[3], []).append(r)
    return out


def cut_sessions(rows, gap):
    sessions_, last = [], None
    for r in rows:
        if last is None or r[-1] - last > gap:
            sessions_.append([])
        sessions_[-1].append(r)
        last = r[-1]
    return sessions_


@pytest.mark.parametrize("seed", range(3))
def test_sessions(spark, seed):
    rows = sample(seed)
    ev = spark.createDataFrame(rows, DDL)
    gap = timedelta(minutes=30)
    want = sorted((d, s[0][-1], s[-1][-1], len(s)) for d, rs in by_device(rows).items() for s in cut_sessions(rs, gap))
    got = sorted((r.device_id, r.started_at, r.ended_at, r.events_count) for r in sessions(ev).collect())
    assert got == want
    assigned = {r.id: r.session_start for r in sessionize(ev).collect()}
    assert assigned == {e[0]: s[0][-1] for rs in by_device(rows).values() for s in cut_sessions(rs, gap) for e in s}


def level(rows, steps, window):
    """Furthest step of any chain, tried from every possible start."""
    best = 0
    for i, r in enumerate(rows):
        if r[4] != steps[0]:
            continue
        reached, at = 1, i
        for step in steps[1:]:
            nxt = next((j for j in range(at + 1, len(rows)) if rows[j][4] == step and rows[j][-1] <= r[-1] + window), None)
            if nxt is None:
                break
            reached, at = reached + 1, nxt
        best = max(best, reached)
    return best


@pytest.mark.parametrize("seed, steps, hours", [(0, "abc", 2), (1, "aba", 1), (2, "abca", 5), (3, "ab", 24), (4, "aa", 1)])
def test_funnel(spark, seed, steps, hours):
    rows = sample(seed)
    got = {r.device_id: r.level for r in funnel_levels(spark.createDataFrame(rows, DDL), list(steps), hours * 3600).collect()}
    for device, rs in by_device(rows).items():
        assert got.get(device, 0) == level(rs, list(steps), timedelta(hours=hours))


@pytest.mark.parametrize("seed", range(2))
def test_conversions(spark, seed):
    rows, window = sample(seed), timedelta(hours=3)
    totals, hits = {}, {}
    for device, rs in by_device(rows).items():
        start = None
        for r in rs:
            if r[4] == "b" and start and r[-1] <= start + window:
                hits.setdefault(start.date(), set()).add(device)
            if r[4] == "a":
                start = r[-1]
                totals.setdefault(start.date(), set()).add(device)
    got = {r.bucket.date(): (r.total, r.conversions) for r in conversion_series(spark.createDataFrame(rows, DDL), "a", "b", PERIOD, window=3 * 3600).collect()}
    assert got == {d: (len(t), len(hits.get(d, ()))) for d, t in totals.items()}


@pytest.mark.parametrize("seed, steps, backwards", [(0, 3, False), (1, 10, False), (2, 2, True), (3, 5, True)])
def test_journeys(spark, seed, steps, backwards):
    rows = [r for r in sample(seed) if r[5]]
    ev = sessionize(spark.createDataFrame(rows, DDL), 4 * 3600)
    of = {r.id: r.session_id for r in ev.collect()}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r[-1], r[0]), reverse=backwards):
        sequences.setdefault(of[r[0]], []).append(r[5])
    want = set()
    for sid, paths in sequences.items():
        collapsed = [p for i, p in enumerate(paths) if i == 0 or p != paths[i - 1]][:steps]
        for i, p in enumerate(collapsed):
            if p in collapsed[:i]:
                break
            want.add((sid, i + 1, p))
    got = {(r.session_id, r.position, r.item) for r in distinct_prefix(ev, "path", steps, backwards).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_rapid_duplicates(spark, seed):
    rows = sample(seed, 300, 40, 0.013)
    rows = [(*r[:4], "n", "p", *r[6:]) for r in rows]
    want = set()
    for rs in by_device(rows).values():
        kept = None
        for r in rs:
            if kept is None or r[-1] >= kept + timedelta(milliseconds=100):
                kept = r[-1]
                want.add(r[0])
    assert {r.id for r in suppress_rapid(spark.createDataFrame(rows, DDL)).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_features(spark, seed):
    names = {"a": "page_view", "b": "add_to_cart", "c": "purchase", "x": "other"}
    rows = [(*r[:4], names[r[4]], *r[5:]) for r in sample(seed)]
    ttl, want = timedelta(minutes=45), {}
    for device, rs in by_device(rows).items():
        for state in cut_sessions(rs, ttl):
            views, carts, products, viewed = 0, 0, set(), None
            for r in state:
                if r[4] == "page_view":
                    if viewed is not None and r[-1] - viewed > ttl:
                        products = set()
                    views, viewed = views + 1, r[-1]
                    products.add(r[6])
                elif r[4] == "add_to_cart":
                    carts += 1
                elif r[4] == "purchase":
                    carts = 0
            if viewed is None or state[-1][-1] - viewed > ttl:
                products = set()
            want[device, state[0][-1]] = (views, carts, carts * 100, max(1, len(products)), state[-1][4] == "purchase")
    ev = spark.createDataFrame(rows, DDL).selectExpr("*", "'s' AS session_id")
    got = {(r.device_id, r.state_start): (r.views, r.carts, r.cart_value_usd, r.distinct_products, r.has_purchase) for r in features(ev).collect()}
    assert got == want


def test_ipv6_digits(spark):
    import ipaddress

    from tidemark.enrich.network import ip_digits

    texts = ["::", "::1", "1::", "2001:DB8::5", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "fe80::1:0", "0:0:0:0:0:0:0:0", "abcd::ef01:2345",
             "", ":", ":::", "1:2", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "g::1", ":1:2:3:4:5:6:7", "1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:7:", None]

    def want(t):
        try:
            return f"{int(ipaddress.IPv6Address(t)):032x}"
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", ip_digits("ip").alias("n")).collect()
    assert {r.ip: r.n for r in rows} == {t: want(t) if t is not None else None for t in texts}
