"""Tables that only steps in between read: they go, and features are put together in one shuffle."""

import os

from pyspark.sql import functions as F

from tests.test_risk import _at, _world
from veridan.operators import asof, features
from veridan.operators.tables import passing, stored
from veridan.queries import scoring_queries


def _tables(spark) -> set[str]:
    return set(os.listdir(d)) if os.path.isdir(d := spark.conf.get("spark.checkpoint.dir")) else set()


def _conf(spark) -> list:
    return [spark.conf.get(k, None) for k in ("spark.sql.codegen.hugeMethodLimit", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]


def test_only_what_is_kept_stays(spark):
    before, conf = _tables(spark), _conf(spark)
    with passing(spark) as keep:
        stored(spark.range(5), "gone")
        asof.together([lambda: stored(spark.range(3).select(F.col("id").alias("order_id"), F.lit(1).alias("a")), "thread")]).collect()
        kept = keep(stored(spark.range(7).repartition(3), "kept"))
    assert kept.count() == 7 and {x.split("-")[0] for x in _tables(spark) - before} == {"kept"} and _conf(spark) == conf
    try:
        with passing(spark):
            stored(spark.range(5), "gone")
            raise KeyError
    except KeyError:
        assert {x.split("-")[0] for x in _tables(spark) - before} == {"kept"} and _conf(spark) == conf


def test_gate_keeps_its_result_only(spark):
    tables, _, _ = _world(spark, 4, 30)
    before = _tables(spark)
    diff = features.causality_gate(tables, [_at(8), _at(20)], categories=["a", "b"])
    assert {x.rsplit("-", 1)[0] for x in _tables(spark) - before} <= {"gate-worlds", "gate-diff"}
    assert diff.count() == 2 * 60 and diff.where("rows_differing > 0").count() == 0


def test_parts_are_dealt_by_order_id_once(spark):
    own = spark.range(50).select(F.col("id").alias("order_id"), F.rand(1).alias("x"))
    joined = asof.together([lambda: own, lambda: own.withColumnRenamed("x", "y")]).join(own.withColumnRenamed("x", "z").hint("merge"), "order_id")
    joined.collect()
    assert joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
    assert joined.where("x <> y OR x <> z").count() == 0 and joined.count() == 50

def test_scoring_keeps_frame_and_model_only(spark, sf, tmp_path):
    for name in ("orders", "lineitem", "part", "customer"):  # a folder that no earlier test has fitted
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = _tables(spark)
    frame, columns, m = scoring_queries._fitted(spark, str(tmp_path))
    assert {x.split("-")[0] for x in _tables(spark) - before} == {"scoring"}
    assert frame.count() == spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority NOT IN ('1-URGENT', '2-HIGH')").count() == frame.select("order_id").distinct().count()
    assert set(columns) < set(frame.columns) and m.getNumTrees == 20
