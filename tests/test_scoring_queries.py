"""Scores, attributions and payloads of the registered queries come from one model over the real features."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridan.operators.features import RATES, RUNNING_TOTALS
from veridan.plans import explain, model
from veridan.queries import scoring_queries as q


def test_payloads_follow_the_attribution(spark, sf, monkeypatch):
    frame, columns, m = q._fitted(spark, sf)
    assert len(columns) > 40 and not set(columns) & set(RUNNING_TOTALS) and set(columns) >= set(RATES) and "comp_size" in columns
    monkeypatch.setattr(q, "_fitted", lambda *_: (frame, columns, m))
    monkeypatch.setattr(q, "LO", 0.02)  # the fold is small: more of it is flagged
    flagged = {r["order_id"]: r for r in q._banded(frame, columns, m).where("band <> 'pass'").collect()}
    assert flagged
    by: dict = {}
    for r in q.tree_attribution(spark, sf).collect():
        assert r["value"] == pytest.approx(float(flagged[r["order_id"]][r["feature"]] or 0.0))
        by.setdefault(r["order_id"], []).append(r)
    assert set(by) == set(flagged) and all(len(v) == len(columns) for v in by.values())
    got = {json.loads(r["payload"])["order"]["order_id"]: json.loads(r["payload"]) for r in q.explanation_payload(spark, sf).collect()}
    assert set(got) == set(flagged)
    raw = {r["order_id"]: r["raw_p"] for r in model.raw_scores(m, frame.where("split = 'test'"), columns).collect()}
    base = model.base_margin(m)
    for i, p in got.items():
        up = sorted((r for r in by[i] if r["contribution"] > 0), key=lambda r: (-r["contribution"], r["feature"]))[:5]
        assert [e["feature"] for e in p["evidence"]] == [r["feature"] for r in up]
        assert p["probability"] == flagged[i]["p"] and p["decision_band"] == flagged[i]["band"]
        facts = flagged[i]
        assert (explain.CAVEATS[3][1] in p["caveats"]) == (facts["comp_size"] <= 1) and (explain.CAVEATS[0][1] in p["caveats"]) == (facts["cust_prior_orders"] == 0)
        margin = base + sum(r["contribution"] for r in by[i])
        assert raw[i] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-6)


def test_evidence_sentences_and_caveats_of_flagged_orders(spark, sf, monkeypatch):
    """Against a reading of each flagged order's own attributions and features."""
    fitted = q._fitted(spark, sf)
    monkeypatch.setattr(q, "_fitted", lambda *_: fitted)
    monkeypatch.setattr(q, "LO", 0.02)
    flagged, a = q._flagged(spark, sf)
    facts, by = {r["order_id"]: r for r in flagged.collect()}, {}
    for r in a.withColumn("sentence", explain.sentence(F.col("feature"), F.col("value"))).collect():
        by.setdefault(r["order_id"], []).append(r)
    said = {(r["order_id"], r["feature"]): r["sentence"] for r in q.flagged_sentences(spark, sf).collect()}
    assert len(said) == sum(map(len, by.values())) and len({f for _, f in said}) > 40
    for (i, f), s in said.items():
        x = facts[i][f]
        if f == "comp_size":
            assert s == f"the account sits in an identity cluster of {x} linked accounts"
        if f == "addr_distinct_customers":
            assert s == f"{x} other accounts have shipped to this address"
    repeated = 0
    for r in q.flagged_evidence(spark, sf).collect():
        own = sorted(by[r["order_id"]], key=lambda x: (-x["contribution"], x["feature"]))
        up = [x["sentence"] for x in own if x["contribution"] > 0][:5]
        down = [x["sentence"] for x in reversed(own) if x["contribution"] < 0][:2]
        assert r["evidence"] == "; ".join(dict.fromkeys(up)) and r["counter_evidence"] == "; ".join(dict.fromkeys(down)) and r["n_evidence"] == len(up)
        repeated += len(set(up)) < len(up)
    for r in q.flagged_caveats(spark, sf).collect():
        f = facts[r["order_id"]]
        rules = [f["cust_prior_orders"] == 0, f["addr_distinct_customers"] >= 1 and f["comp_max_tenure_days"] > 365, f["addr_is_new_variant_of_known_cluster"] >= 0.5, f["comp_size"] <= 1, f["phone_neighbours_active"] > 0]
        assert r["caveats"] == " ".join([text for (_, text), yes in zip(explain.CAVEATS, rules, strict=True) if yes] or [explain.NO_CAVEAT])


def test_a_saved_model_follows_its_inputs(spark, sf, tmp_path):
    """The same inputs have the same name, a changed file another one."""
    import os
    import shutil

    for t in q._INPUTS:
        shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    first = q._state(spark, str(tmp_path))
    assert q._state(spark, str(tmp_path)) == first
    os.chmod(tmp_path / "part.parquet", 0o644)
    os.utime(tmp_path / "part.parquet", (1, 1))
    assert q._state(spark, str(tmp_path)) != first


def test_attribution_equals_enumerated_subsets(spark):
    """Shapley values by definition: every subset of features, expectations over a tree's own rows."""
    rng = np.random.default_rng(3)
    t = {"feature": np.array([0, 1, -1, 2, -1, -1, 1, -1, -1]), "cut": np.array([0.5, 0.3, 0, 0.6, 0, 0, 0.7, 0, 0]), "left": np.array([1, 2, -1, 4, -1, -1, 7, -1, -1]), "right": np.array([6, 3, -1, 5, -1, -1, 8, -1, -1]),
         "value": np.array([0, 0, 1.0, 0, -2.0, 0.5, 0, 3.0, -1.0]), "n": np.array([100, 60, 25, 35, 20, 15, 40, 30, 10])}
    x = rng.random((40, 3))

    def expected(row, known, i=0):
        f = t["feature"][i]
        if f < 0:
            return t["value"][i]
        kids = (t["left"][i], t["right"][i])
        if f in known:
            return expected(row, known, kids[0] if row[f] <= t["cut"][i] else kids[1])
        return sum(t["n"][k] / t["n"][i] * expected(row, known, k) for k in kids)

    phi = model._attribute([t], x)
    for row, got in zip(x, phi, strict=True):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (expected(row, {*s, f}) - expected(row, set(s))) for k in range(3) for s in itertools.combinations(rest, k))
            assert got[f] == pytest.approx(want, abs=1e-12)
