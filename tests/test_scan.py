"""Prefix scans and ranks against plain Python, with keys that reach over many ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veridan.operators import scan

DAY = 86400


def _rows(seed, n=600):
    """A third of the rows are one key's, a tenth are one second's; some times lie decades apart."""
    rng = random.Random(seed)
    return [
        (i, None if rng.random() < 0.1 else 0 if rng.random() < 0.4 else rng.randrange(20), 10**9 if rng.random() < 0.1 else 10**9 + rng.randrange(0, rng.choice([40, 400, 16000])) * DAY, rng.choice([None, 1, 5]), rng.choice([None, 7.25, rng.random() * 1e6]))
        for i in range(n)
    ]


@pytest.mark.parametrize("key", [["k"], []])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_prefix_equals_a_loop(spark, key, parts):
    rows = _rows(parts)
    df = spark.createDataFrame(rows, "id long, k long, ts_sec long, n int, x double")
    what = scan.Prefix(
        sums={"s": "n"}, least={"lo": "x"}, most={"hi": "x"}, fades={"d7": ("if(n > 1, 2, 1)", "ts_sec - 100", 7.0 * DAY), "d30": (F.lit(1), "ts_sec", 30.0 * DAY)}, moments={("m_n", "m_mean", "m_m2"): "x"}
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = scan.prefix(df, key, ["ts_sec", "id"], what, "t", keep="id % 3 > 0")
        plan = got._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {r[0] for r in rows if r[0] % 3}
    assert "rangepartitioning" not in plan
    for i, k, t, *_ in rows:
        if i % 3 == 0:
            continue
        past = [r for r in rows if (not key or r[1] == k) and (r[2], r[0]) < (t, i)]
        xs = [r[4] for r in past if r[4] is not None]
        mean = sum(xs) / len(xs) if xs else 0.0
        g = got[i]
        assert (g["s"], g["lo"], g["hi"], g["m_n"]) == (sum(r[3] or 0 for r in past), min(xs, default=None), max(xs, default=None), len(xs))
        assert g["m_mean"] == pytest.approx(mean, rel=1e-9) and g["m_m2"] == pytest.approx(sum((x - mean) ** 2 for x in xs), rel=1e-7, abs=1e-3)
        assert g["d30"] == pytest.approx(sum(math.exp(-(t - r[2]) / 30 / DAY) for r in past), rel=1e-9, abs=1e-15)
        assert g["d7"] == pytest.approx(sum((2 if (r[3] or 0) > 1 else 1) * math.exp(-(t - r[2] + 100) / 7 / DAY) for r in past), rel=1e-9, abs=1e-15)


def test_equal_values_have_no_spread(spark):
    df = spark.range(400).select("id", F.lit(1).alias("k"), F.col("id").alias("ts_sec"), F.lit(1000.37).alias("x"))
    what = scan.Prefix(moments={("n", "mean", "m2"): "x"})
    assert all(r["m2"] < 1e-12 for r in scan.prefix(df.repartition(9), ["k"], ["ts_sec", "id"], what, "t").collect())


def test_empty(spark):
    df = spark.createDataFrame([], "id long, k long, ts_sec long, n int")
    assert scan.prefix(df, ["k"], ["ts_sec", "id"], scan.Prefix(sums={"s": "n"}), "t").count() == 0
    assert scan.ranked(df, ["k"], ["id"], "t").count() == 0


def test_ranked(spark):
    rows = _rows(3)
    got = scan.ranked(spark.createDataFrame(rows, "id long, k long, ts_sec long, n int, x double").repartition(9), ["k"], [F.col("ts_sec"), F.col("id")], "t")
    by = {}
    for i, k, t, *_ in rows:
        by.setdefault(k, []).append((t, i))
    want = {i: (j, len(v)) for v in by.values() for j, (_, i) in enumerate(sorted(v))}
    assert {r["id"]: (r["_rank"], r["_total"]) for r in got.collect()} == want
