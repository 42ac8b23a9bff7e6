"""As-of components against a naive replay: all columns, ties, many stretches of time, one component that holds nearly everything."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veridan.operators import asof, graph

DAY = 86400


def _world(spark, seed, n, customers, devices, hub=0.0):
    """``hub``: share of orders on one device."""
    rng = random.Random(seed)
    o = [
        (i, rng.randrange(customers), 0 if rng.random() < hub else 1 + rng.randrange(devices), f"c{rng.randrange(3 * devices)}", rng.randrange(customers), 10**9 + rng.randrange(60) * 43200, rng.randrange(2), float(rng.randrange(100, 900)))
        for i in range(n)
    ]
    orders = spark.createDataFrame(o, "order_id long, customer_id long, device_id long, cluster string, phone_id long, ts_sec long, cod int, value_inr double")
    r = {x[0]: x[5] + rng.randrange(0, 6) * 43200 for x in o if rng.random() < 0.4}
    returns = spark.createDataFrame(list(r.items()), "order_id long, s long").select("order_id", F.timestamp_seconds("s").alias("return_ts"))
    signup = {c: 10**9 - c * DAY for c in range(customers) if c % 7}
    people = spark.createDataFrame(list(signup.items()), "customer_id long, s long").select("customer_id", F.timestamp_seconds("s").alias("signup_ts"))
    # Some phones share a number, some are adjacent, one has none.
    number = {p: 7 * 10**9 + (p // 3) * 4 if p % 5 else 7 * 10**9 for p in range(customers) if p != 4}
    phones = spark.createDataFrame([(p, str(x)) for p, x in number.items()] + [(4, None)], "phone_id long, msisdn string")
    return orders, returns, people, phones, o, r, signup, number


def _naive(o, returns, signup, number):
    """Walk the events, look at everything before."""
    part, since, out, growth, seen, returned = {}, {}, {}, [], [], []
    events = sorted([(x[5], 1, x[0], x) for x in o] + [(t, 0, i, next(x for x in o if x[0] == i)) for i, t in returns.items()], key=lambda e: e[:3])
    for t, kind, i, x in events:
        if kind == 0:
            returned.append(x)
            continue
        c = x[1]
        part.setdefault(c, {c})
        since.setdefault(c, signup.get(c, t))
        for y in seen:
            phone = y[4] != x[4] and y[4] in number and x[4] in number and abs(number[y[4]] - number[x[4]]) <= 5
            if y[2] == x[2] or y[3] == x[3] or phone:
                a, b = part[c], part[y[1]]
                if a is not b:
                    a |= b
                    for m in a:
                        part[m] = a
                    growth.append((t, frozenset(a)))
        mine = part[c]
        past = [y for y in seen if y[1] in mine]
        fade = lambda ts, tau: sum(math.exp(-(t - s) / (tau * DAY)) for s in ts)
        size, n, total = len(mine), len(past), sum(y[7] for y in past)
        mean = max(t - sum(since[m] for m in mine) / size, 0) / DAY
        out[i] = (
            size, n, (sum(y[1] in mine for y in returned) + 1) / (n + 8), (sum(y[6] for y in past) + 1) / (n + 2), fade([y[5] for y in past], 7), fade([y[5] for y in past], 30),
            fade([g for g, m in growth if m <= mine], 7), mean, max(t - min(since[m] for m in mine), 0) / DAY, len({y[2] for y in past}), len({y[3] for y in past}),
            total / size, n / size, n / (size * max(mean, 1.0)),
        )
        seen.append(x)
    return out


@pytest.mark.parametrize(("seed", "n", "customers", "devices", "hub", "stretch"), [(1, 120, 30, 40, 0.0, 500), (2, 200, 60, 150, 0.05, 4), (3, 300, 120, 400, 0.9, 16), (4, 150, 90, 300, 0.3, 1)])
def test_all_columns(spark, seed, n, customers, devices, hub, stretch):
    orders, returns, people, phones, o, r, signup, number = _world(spark, seed, n, customers, devices, hub)
    edges = graph.stored(graph.identity_edges(orders, phones), "edges")
    got = {x[0]: x[1:] for x in graph.component_features(orders, returns, people, edges, stretch).collect()}
    want = _naive(o, r, signup, number)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i] == pytest.approx(w, rel=1e-9, abs=1e-9), i


def test_ways_are_short_and_end_in_the_final_component(spark):
    """One hub that newcomers join one by one, in an order of ids that is bad for least ids: ways stay about as long as the logarithm."""
    n = 3000
    edges = graph.stored(spark.range(1, n).select(F.lit(n).alias("a"), (F.lit(n) - F.col("id")).alias("b"), F.col("id").alias("ts_sec"), F.col("id").alias("order_id")), "edges")
    for stretch in (5000, 700):
        ways = {x["customer_id"]: [w["label"] for w in x["way"]] for x in graph.label_ways(edges, stretch).collect()}
        assert len(ways) == n - 1 and len({w[-1] for w in ways.values()}) == 1
        assert max(map(len, ways.values())) <= 6 * math.log(n) and sum(map(len, ways.values())) < 4 * n


def test_many_phones_of_one_number(spark):
    """Rows in W6 and G3 grow with the phones, not with their pairs."""
    n = 4000
    orders = spark.range(n).select(F.col("id").alias("order_id"), F.col("id").alias("customer_id"), F.col("id").alias("device_id"), F.col("id").cast("string").alias("cluster"), F.col("id").alias("phone_id"), F.col("id").alias("ts_sec"))
    phones = spark.range(n).select(F.col("id").alias("phone_id"), F.lit("7000000000").alias("msisdn"))
    assert graph.identity_edges(orders, phones).count() < 2 * n
    got = {r[0]: (r[1], r[2]) for r in asof.phone_part(orders, phones).collect()}
    assert got == {i: (i, i) for i in range(n)}
