"""Properties of the risk jobs on small worlds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veridan.functions.columns import split_unit, with_address_parts
from veridan.operators import asof, features, graph
from veridan.plans import costs, explain, metrics, model, splits
from veridan.sources.tables import guard

DAY = 86400


def test_addresses(spark):
    same = ["Flat 4B, Sai Residency, MG Road", "Flt 4-B, SAI RES.  MG Road", "Apt 4 B , Sai Residency - MG Road", "No. 4B, Sai Residency, MG Road"]
    other = ["Flat 5B, Sai Residency, MG Road", "Flat 4B, Green Towers, MG Road", None, ""]
    parts = with_address_parts(spark.createDataFrame([(x,) for x in same + other], "raw string"), "raw", "flat", "words")
    rows = [tuple(r) for r in parts.select("flat", F.array_join("words", " ")).collect()]
    assert len(set(rows[:4])) == 1 and rows[0] == ("4b", "mg residency road sai")
    assert len(set(rows)) == 4 and rows[-1] == ("?", "")


def test_phones(spark):
    p = spark.createDataFrame([(1, "7000000000"), (2, "7000000001"), (3, "7000000002"), (4, "7000009999"), (5, None)], "phone_id long, msisdn string")
    got = {tuple(r) for r in asof.phone_neighbours(p).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_guard(spark):
    with pytest.raises(ValueError, match="return_flag"):
        guard("orders", spark.createDataFrame([], "order_id long, return_flag int"))


def test_costs_at_2000(spark):
    r = costs.order_costs(spark.createDataFrame([(1, 2000.0)], "order_id long, value_inr double")).first()
    assert (round(r["miss_cost"], 6), round(r["alarm_cost"], 6)) == (1640.0, 441.4)


def _world(spark, seed, n=60):
    """Few entities, few seconds: ties and shared entities everywhere."""
    rng = random.Random(seed)
    o = [
        (i, rng.randrange(8), rng.randrange(10), rng.randrange(10), rng.randrange(8), rng.randrange(0, 40) * 43200 + 10**9, rng.choice(["COD", "prepaid"]), rng.choice("ab"), float(rng.randrange(100, 900)), 1, 0)
        for i in range(n)
    ]
    orders = spark.createDataFrame(o, "order_id long, customer_id long, device_id long, address_id long, phone_id long, s long, payment_mode string, category string, value_inr double, item_count int, promo_used int")
    orders = orders.withColumn("order_ts", F.timestamp_seconds("s")).drop("s")
    r = [(x[0], x[5] + rng.randrange(0, 6) * 43200) for x in o if rng.random() < 0.4]
    returns = spark.createDataFrame(r, "order_id long, s long").select("order_id", F.timestamp_seconds("s").alias("return_ts"))
    cust = spark.createDataFrame([(c, 10**9 - c * DAY) for c in range(8)], "customer_id long, s long").select("customer_id", F.timestamp_seconds("s").alias("signup_ts"))
    addr = spark.createDataFrame([(a, f"Flat {a // 2}A, Sai {'Residency' if a % 2 else 'Res'}", 110000 + a % 3) for a in range(10)], "address_id long, raw_line string, pincode int")
    phones = spark.createDataFrame([(p, str(7000000000 + p * 4)) for p in range(8)], "phone_id long, msisdn string")
    tables = {"orders": orders, "returns": returns, "customers": cust, "addresses": addr, "phones": phones}
    return tables, o, dict(r)


def _replay(o, returns, cluster):
    """Naive: walk events, look at everything before."""
    links, seen, out, growth = {}, [], {}, []
    comp = lambda c: links.setdefault(c, {c})
    events = sorted([(x[5], 1, x[0], x) for x in o] + [(t, 0, i, next(x for x in o if x[0] == i)) for i, t in returns.items()], key=lambda e: e[:3])
    returned = []
    for t, kind, i, x in events:
        if kind == 0:
            returned.append(x)
            continue
        c = x[1]
        comp(c)
        for y in seen:
            if y[2] == x[2] or cluster[y[3]] == cluster[x[3]] or (y[4] != x[4] and abs(y[4] - x[4]) * 4 <= 5):
                a, b = comp(c), comp(y[1])
                if a is not b:
                    a |= b
                    for m in a:
                        links[m] = a
                    growth.append((t, frozenset(a)))
        mine = comp(c)
        past = [y for y in seen if y[1] in mine]
        own = [y for y in seen if y[1] == c]
        out[i] = {
            "comp_size": len(mine), "comp_prior_orders": len(past), "comp_distinct_devices": len({y[2] for y in past}),
            "comp_return_rate": (sum(y[1] in mine for y in returned) + 1) / (len(past) + 8),
            "comp_growth_d7": sum(math.exp(-(t - g) / (7 * DAY)) for g, m in growth if m <= mine),
            "cust_prior_orders": len(own), "cust_orders_d7": sum(math.exp(-(t - y[5]) / (7 * DAY)) for y in own),
            "cust_prior_returns": sum(y[1] == c for y in returned), "dev_distinct_customers": len({y[1] for y in seen if y[2] == x[2]} - {c}),
            "phone_neighbour_orders": sum(y[4] != x[4] and abs(y[4] - x[4]) * 4 <= 5 for y in seen),
            "addr_variant_count": len({y[3] for y in seen if cluster[y[3]] == cluster[x[3]]}), "pin_prior_orders": sum(y[3] % 3 == x[3] % 3 for y in seen),
        }
        seen.append(x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_a_naive_replay(spark, seed):
    tables, o, returns = _world(spark, seed)
    cluster = {r["address_id"]: r["cluster"] for r in features.clusters(tables["addresses"]).collect()}
    got = {r["order_id"]: r.asDict() for r in features.build_features(**tables, categories=["a", "b"]).collect()}
    want = _replay(o, returns, cluster)
    assert len(got) == len(o)
    for i, w in want.items():
        for k, v in w.items():
            assert got[i][k] == pytest.approx(v, abs=1e-9), (i, k)


def _at(half_days):
    return F.timestamp_seconds(F.lit(10**9 + half_days * 43200))


def test_gate(spark):
    tables, _, _ = _world(spark, 3, 40)
    d = features.causality_gate(tables, [_at(8), _at(20), _at(33)], categories=["a", "b"])
    assert d.count() == 3 * 60 and d.where("rows_differing > 0").count() == 0
    assert features.causality_gate(tables, _at(20), categories=["a", "b"]).count() == 60


def test_gate_finds_a_leak_at_one_cut(spark):
    """A part that counts the orders from the 20th to the 23rd half day, whenever its order was placed: only a cut among these shows it."""
    tables, o, _ = _world(spark, 3, 40)
    window = F.col("ts_sec").between(10**9 + 20 * 43200, 10**9 + 23 * 43200)

    def leak(orders, events):
        n = orders.groupBy("world").agg(F.sum(window.cast("int")).alias("soon"))
        return orders.select("order_id", "world").join(n, "world").select("order_id", "soon")

    assert sum(10**9 + 20 * 43200 <= x[5] <= 10**9 + 23 * 43200 for x in o) > 0
    d = {(r["cut"], r["feature"]): r["rows_differing"] for r in features.gate_table(tables, [_at(22), _at(30)], categories=["a", "b"], extra=(leak,)).collect()}
    assert {k for k, n in d.items() if n} == {(1, "soon")} and d[1, "soon"] == sum(x[5] < 10**9 + 22 * 43200 for x in o)
    with pytest.raises(ValueError, match="soon"):
        features.causality_gate(tables, [_at(22)], categories=["a", "b"], extra=(leak,))


def test_equal_seconds_and_returns(spark):
    o = spark.createDataFrame([(1, 1, 100), (2, 1, 100), (3, 1, 200)], "order_id long, customer_id long, s long").select("order_id", "customer_id", F.col("s").alias("ts_sec"))
    r = spark.createDataFrame([(1, 200), (2, 201)], "order_id long, s long").select("order_id", F.timestamp_seconds("s").alias("return_ts"))
    e = asof.event_stream(o, r)
    got = {x["order_id"]: (x["n"], x["r"]) for x in asof.running(e, "customer_id", {"n": "kind", "r": "1 - kind"}).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (2, 1)}


def _scored(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(0, 50) / 50, int(rng.random() < 0.2), float(rng.randrange(100, 3000))) for i in range(n)]
    return spark.createDataFrame(rows, "order_id long, p double, is_abuse int, value_inr double"), rows


def _brute(rows, lo, hi):
    c = 0
    for _, p, y, v in rows:
        miss, alarm = 200 + 0.72 * v, 0.0612 * v + 319
        c += (miss if y else 0) if p < lo else (0 if y else alarm) if p >= hi else 32 + 0.12 * (miss if y else alarm)
    return c / len(rows) * 1000


def test_sweep_equals_brute_force(spark):
    df, rows = _scored(spark)
    for r in costs.band_sweep(df, 8).collect():
        assert r["cost_per_1000"] == pytest.approx(_brute(rows, r["lo"], r["hi"]))
    one = costs.policy_cost(df, 0.3, 0.7).first()
    assert one["cost_per_1000"] == pytest.approx(_brute(rows, 0.3, 0.7)) and one["pass_share"] + one["review_share"] + one["action_share"] == pytest.approx(1)


def test_no_feasible_band(spark):
    df, _ = _scored(spark)
    with pytest.raises(ValueError, match="capacity"):
        costs.select_policy(df, costs.replace(costs.COST, capacity=-1.0), points=5, n=4)


def test_auc(spark):
    df, rows = _scored(spark)
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)
    ap, seen, hit = 0.0, 0, 0
    for p in sorted({r[1] for r in rows}, reverse=True):
        new = [r for r in rows if r[1] == p]
        seen, hit = seen + len(new), hit + sum(r[2] for r in new)
        ap += sum(r[2] for r in new) / len(pos) * hit / seen
    assert metrics.pr_auc(df).first()[0] == pytest.approx(ap)


def test_splits(spark):
    rows = [(i, f"g{i % 17}", i % 5 - 1, i * DAY) for i in range(200)]
    t = spark.createDataFrame(rows, "order_id long, group_key string, ring_id long, s long").withColumn("order_ts", F.timestamp_seconds("s"))
    s = {r["group_key"]: r["split"] for r in splits.group_split(t).collect()}
    assert len(s) == 17 and sorted(s.values()).count("train") == 11
    split = {r["order_id"]: r["split"] for r in splits.temporal_split(t, F.timestamp_seconds(F.lit(100 * DAY))).collect()}
    assert {split[i] for i in range(100)} == {"train"} and {split[i] for i in range(100, 200) if i % 5} == {"drop"} and {split[i] for i in range(100, 200, 5)} == {"test"}
    carved = {r["order_id"]: r["split"] for r in splits.carve_validation(t).collect()}
    groups = lambda k: {i % 17 for i, v in carved.items() if v == k}
    assert not groups("train") & groups("val")
    f = splits.fingerprint(t, "order_id", 50)
    splits.verify_fingerprint(t.repartition(7), "order_id", f, 50)
    with pytest.raises(ValueError):
        splits.verify_fingerprint(t.where("order_id <> 3"), "order_id", f, 50)
    key = spark.createDataFrame([(3, -1, 9), (-1, 2, 9), (-1, -1, 9)], "ring_id long, household_id long, customer_id long").select(split_unit())
    assert [r[0] for r in key.collect()] == ["ring_3", "hh_2", "cust_9"]


def test_evidence(spark):
    a = spark.createDataFrame([(1, "comp_size", 4.9, 0.5), (1, "cust_return_rate", 0.25, 0.7), (1, "item_count", 2.0, -0.1), (1, "cust_prior_cod", 2.0, -0.3)], "order_id long, feature string, value double, contribution double")
    r = explain.top_evidence(a).first()
    assert [e["sentence"] for e in r["evidence"]] == ["the account's smoothed return rate is 25%", "the account sits in an identity cluster of 4 linked accounts"]
    assert [e["feature"] for e in r["counter_evidence"]] == ["cust_prior_cod", "item_count"] and r["counter_evidence"][0]["sentence"] == "cust_prior_cod = 2.000"
    f = spark.createDataFrame([(1, 5, 0, 0.0, 0, 2, 0)], "order_id long, cust_prior_orders int, addr_distinct_customers int, comp_max_tenure_days double, addr_is_new_variant_of_known_cluster int, comp_size int, phone_neighbours_active int")
    assert f.select(explain.caveats()).first()[0] == [explain.NO_CAVEAT]


def test_attributions_add_up(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, c, int(a + b * c > 0.8)) for i, a, b, c in rows], "order_id long, a double, b double, c double, is_abuse int")
    m = model.train_scorer(df, ["a", "b", "c"], trees=5)
    few = df.limit(20)
    total = {r["order_id"]: r["s"] for r in model.tree_attribution(m, few, ["a", "b", "c"]).groupBy("order_id").agg(F.sum("contribution").alias("s")).collect()}
    from pyspark.ml.functions import vector_to_array

    raw = m.transform(model._vectors(few, ["a", "b", "c"])).select("order_id", vector_to_array("rawPrediction")[1].alias("margin")).collect()
    base = model.base_margin(m)
    for r in raw:  # Spark's raw prediction is the margin itself
        assert total[r["order_id"]] + base == pytest.approx(r["margin"], abs=1e-6)
