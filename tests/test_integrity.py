"""Changes found by the digest tree against a plain comparison; the input contract against a reading row by row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridan.plans import integrity
from veridan.sources import contract

SCHEMA = "id long, a string, b double"


def _plain(before, now):
    group = lambda rows: {i: Counter(r for r in rows if r[0] == i) for i in {r[0] for r in rows}}
    a, b = group(before), group(now)
    return {(i, "added" if i not in a else "missing" if i not in b else "changed") for i in a.keys() | b.keys() if a.get(i) != b.get(i)}


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_are_named(spark, seed):
    rng = random.Random(seed)
    before = [(rng.choice([None, rng.randrange(-500, 40_000)]) if i < 20 else rng.randrange(-500, 40_000), rng.choice([None, "", "x", "x1"]), rng.choice([None, 1.5])) for i in range(500)]
    before += before[:40]
    now = [r for r in before if rng.random() > 0.03]
    now = [(r[0], r[1], 2.5) if rng.random() < 0.03 else r for r in now] + [(50_000 + i, "new", None) for i in range(3)] + [before[60]]
    rng.shuffle(now)
    a, b = (integrity.DigestTree(spark.createDataFrame(x, SCHEMA).repartition(5), "id") for x in (before, now))
    assert {tuple(r) for r in integrity.changed_ids(a, b, spark).collect()} == _plain(before, now)


def test_unchanged_tables_cost_the_top(spark, monkeypatch):
    rows = [(i, "a", 1.0) for i in range(3000)]
    a, b = (integrity.DigestTree(spark.createDataFrame(x, SCHEMA), "id") for x in (rows, rows[::-1]))
    read = []
    level = integrity.DigestTree.level
    monkeypatch.setattr(integrity.DigestTree, "level", lambda self, s, i: read.append(i) or level(self, s, i))
    assert integrity.changed_ids(a, b, spark).count() == 0 and set(read) == {integrity.LEVELS - 1}
    empty = integrity.DigestTree(spark.createDataFrame([], SCHEMA), "id")
    assert integrity.changed_ids(empty, empty, spark).count() == 0
    with pytest.raises(ValueError, match="different"):
        integrity.changed_ids(a, integrity.DigestTree(spark.range(3), "id"), spark)


def test_fields_can_t_run_into_each_other(spark):
    d = spark.createDataFrame([("a", "b|c"), ("a|b", "c"), ("a", None), (None, "a"), ("a", "-"), ("", "a")], "x string, y string").select(integrity.row_digest(["x", "y"]))
    assert d.distinct().count() == 6


def test_contract(spark):
    rules = {"t": {"id": contract.Rule(contract.LongType(), low=0), "x": contract.Rule(contract.DoubleType(), nullable=True, high=9), "m": contract.Rule(contract.StringType(), values=("a", "b"))}}
    rows = [("1", "2.5", "a"), ("-1", None, "b"), ("x", "9.5", "c"), (None, "NaN", None), ("2", "", "a"), ("3", "9", "b")]
    checked = contract.reasons("t", spark.createDataFrame(rows, "id string, x string, m string").withColumn("more", F.lit(1)), rules)
    got = {r["id"]: r["reasons"] for r in checked.collect()}
    assert got == {"1": [], "-1": ["id: below 0"], "x": ["id: type", "x: above 9", "m: value"], None: ["id: null", "x: above 9", "x: not a number", "m: null"], "2": ["x: type"], "3": []}
    good = contract.accepted("t", checked, rules)
    assert good.schema.simpleString() == "struct<id:bigint,x:double,m:string>" and {tuple(r) for r in good.collect()} == {(1, 2.5, "a"), (3, 9.0, "b")}
    assert contract.rejected("t", checked).where("row LIKE '%9.5%'").first()["reasons"] == got["x"]
    n = {r["reason"]: r["n"] for r in contract.report({"t": checked}).collect()}
    assert n["rows"] == 6 and n["rejected"] == 4 and n["x: above 9"] == 2
    assert contract.schema("t", rules)["id"].nullable is False
    with pytest.raises(ValueError, match="lacks"):
        contract.reasons("t", spark.range(1), rules)
