"""Streams that come unordered over several triggers equal one pass over all events in order of time."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from veridan.streaming.features import run_to_table, stream_features

SCHEMA = "order_id long, ts timestamp, kind int, key long, item long, value double, cod int, extra string"
LATE = 50_000


def _events(seed, n=160):
    rng = random.Random(seed)
    return [(i, 10**9 + rng.randrange(0, 400_000), int(rng.random() < 0.7), rng.choice([1, 1, 1, 2, 3]), rng.choice([None, 1, 2, 3]), rng.choice([None, 5.0, 7.5]), rng.choice([None, 0, 1]), "x") for i in range(n)]


def _landed(spark, files):
    """One file a trigger, in the order given; a heartbeat after the last."""
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    beat = [(None, 10**9 + 10**7, 2, 1, None, None, None, None)]
    for rows in [*files, beat]:
        df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s"))
        df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(spark, files, lateness=f"{LATE} seconds"):
    base = tempfile.mkdtemp(prefix="spark-")
    return [r.asDict() for r in run_to_table(stream_features(_landed(spark, files), lateness), base + "/out", base + "/checkpoint").collect()]


def _brute(events):
    out = {}
    at = lambda e: (e[1], e[2], e[0])
    for e in events:
        if e[2] != 1:
            continue
        past = [x for x in events if x[3] == e[3] and at(x) < at(e)]
        own = [x for x in past if x[2] == 1]
        n, ret = len(own), len(past) - len(own)
        out[e[0]] = {
            "key": e[3], "prior_orders": n, "prior_returns": ret, "prior_cod": sum(x[6] or 0 for x in own), "return_rate": (ret + 1) / (n + 8),
            "days_since_last": (e[1] - max(x[1] for x in own)) / 86400 if n else 999.0, "mean_value": sum(x[5] or 0 for x in own) / n if n else 0.0,
            "orders_d7": sum(math.exp(-(e[1] - x[1]) / 604800) for x in own), "orders_d30": sum(math.exp(-(e[1] - x[1]) / 2592000) for x in own),
            "distinct_items": len({x[4] for x in own} - {None}), "age_days": (e[1] - min(x[1] for x in own)) / 86400 if n else 0.0,
        }
    return out


def test_unordered_triggers(spark):
    events = _events(1)
    # Each row arrives at most LATE seconds after a later one.
    rng = random.Random(2)
    arrival = sorted(events, key=lambda e: e[1] + rng.randrange(0, LATE))
    files = [arrival[i : i + 40] for i in range(0, len(arrival), 40)]
    assert any(max(e[1] for e in a) > min(e[1] for e in b) for a, b in zip(files, files[1:], strict=False))
    got = _run(spark, files)
    want = _brute(events)
    assert len(got) == len(want) == len({r["order_id"] for r in got})
    for r in got:
        for k, v in want[r["order_id"]].items():
            assert r[k] == pytest.approx(v, abs=1e-6), (r["order_id"], k)


def test_return_of_a_later_trigger(spark):
    """The return comes a trigger after the order that must see it, within the bound; one beyond it is left out."""
    t = 10**9
    first = [(1, t, 1, 7, 1, 1.0, 0, ""), (2, t + 1000, 1, 7, 1, 1.0, 0, "")]
    second = [(1, t + 1000, 0, 7, 1, 1.0, 0, ""), (None, t + 200_000, 2, 7, None, None, None, "")]
    third = [(9, t + 10, 0, 7, 1, 1.0, 0, ""), (3, t + 300_000, 1, 7, 2, 1.0, 0, "")]
    got = {r["order_id"]: (r["prior_orders"], r["prior_returns"]) for r in _run(spark, [first, second, [(None, t + 200_001, 2, 8, None, None, None, "")], third])}
    assert got == {1: (0, 0), 2: (1, 1), 3: (2, 1)}


def test_no_key_and_nothing(spark):
    assert _run(spark, [[(1, 10**9, 1, None, 1, 1.0, 0, "")]]) == []
