"""Reading inputs, writing results, and feature sets."""

import json

import pytest
from pyspark.sql import functions as F

from veridan.operators import asof, features
from veridan.sources import tables


def test_inputs_are_pruned_and_guarded(spark, tmp_path):
    for name, cols in tables.ALLOWED.items():
        spark.range(3).select(*[F.col("id").alias(c) for c in [*cols, "is_abuse"]]).write.parquet(f"{tmp_path}/{name}")
    got = tables.load_inputs(spark, str(tmp_path))
    assert {k: v.columns for k, v in got.items()} == tables.ALLOWED
    assert got["orders"].count() == 3
    with pytest.raises(ValueError, match="is_abuse"):
        tables.guard("orders", spark.read.parquet(f"{tmp_path}/orders"))
    with pytest.raises(ValueError, match="lacks"):
        tables.guard("phones", spark.range(1).select(F.col("id").alias("phone_id")))


def test_results_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.5), (2, 40 * 86400, 3.5)], "order_id long, s long, v double").withColumn("order_ts", F.timestamp_seconds("s"))
    tables.write_by_month(df, f"{tmp_path}/m")
    assert {(r["order_id"], r["month"]) for r in spark.read.parquet(f"{tmp_path}/m").collect()} == {(1, "1970-01"), (2, "1970-02")}
    tables.write_report(df.select("order_id", "v"), f"{tmp_path}/r")
    (part,) = (tmp_path / "r").glob("part-*.csv")
    assert sorted(part.read_text().splitlines()[1:]) == ["1,2.5", "2,3.5"] and part.read_text().startswith("order_id,v")
    tables.write_payloads(df.select("order_id", F.struct("v").alias("x")), f"{tmp_path}/j")
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*.json") for x in p.read_text().splitlines()]
    assert sorted(x["order_id"] for x in lines) == [1, 2] and all("v" in x["x"] for x in lines)


def test_feature_sets():
    columns = ["value_inr", *features.RUNNING_TOTALS, *features.RATES]
    assert features.feature_set(columns, "all") == columns
    assert features.feature_set(columns, "stable") == ["value_inr", *features.RATES]
    assert features.feature_set(columns, "plain") == ["value_inr", *features.RUNNING_TOTALS]


def test_exact_quantiles_and_full_buckets(spark):
    import numpy as np

    rows = [(g, float(v) if v else None) for g in ("a", None) for v in [3, 1, 1, 7, 0, 9, 2, 2]]
    got = {r["g"]: r["q"] for r in asof.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0, 0.25, 0.5, 1], ["g"], 2.0).collect()}
    assert all(q == np.quantile([3, 1, 1, 7, 9, 2, 2], [0, 0.25, 0.5, 1]).tolist() for q in got.values()) and len(got) == 2
    e = spark.range(50).select(F.col("id").alias("order_id"), (F.col("id") * 1000).alias("ts_sec"), F.lit(1).alias("kind"))
    out = asof.running_two_level(e, [], {"n": F.lit(1)}, most=7)
    assert {r["order_id"]: r["n"] for r in out.collect()} == {i: i for i in range(50)}
