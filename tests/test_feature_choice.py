"""The choice of a feature set: folds by month, and a set without the telling feature loses."""

import random

import pytest

from veridan.plans import feature_choice


def _frame(spark):
    """The label follows ``addr_age_days``, which ``plain`` leaves out; rings 0-2 go on through all months, 90 is new in month 10."""
    rng, rows = random.Random(4), []
    for i in range(1500):
        month, tell = 1 + i % 14, rng.random()
        ring = 90 if month >= 10 and i % 50 == 0 else i % 3 if i % 25 == 0 else -1
        rows.append((i, month, ring, int(tell > 0.8), float(rng.randrange(100, 3000)), tell, rng.random(), rng.random()))
    return rows, spark.createDataFrame(rows, "order_id long, month int, ring_id long, is_abuse int, value_inr double, addr_age_days double, cust_prior_orders double, item_count double")


def test_featureset_experiment(spark):
    rows, frame = _frame(spark)
    got = {r["variant"]: r.asDict() for r in feature_choice.featureset_experiment(frame, ["value_inr", "addr_age_days", "cust_prior_orders", "item_count"], trees=5).collect()}
    seen = lambda last: {r[2] for r in rows if r[2] >= 0 and r[1] <= last}
    cal = [r for r in rows if r[1] == 9 and r[2] not in seen(8)]
    sel = [r for r in rows if 10 <= r[1] <= 12 and r[2] not in seen(9)]
    assert any(r[2] == 90 for r in sel) and len(sel) < sum(10 <= r[1] <= 12 for r in rows)
    assert {v: r["n_features"] for v, r in got.items()} == {"A": 3, "B": 4, "C": 3}
    for r in got.values():
        assert (r["fit_n"], r["cal_n"], r["sel_n"]) == (sum(x[1] <= 8 for x in rows), len(cal), len(sel))
        assert r["sel_base_rate"] == pytest.approx(sum(x[3] for x in sel) / len(sel))
        assert r["band_lo"] < r["band_hi"]
        assert r["chosen"] == ((r["cost_per_1000"], r["variant"]) == min((x["cost_per_1000"], x["variant"]) for x in got.values()))
    assert got["A"]["pr_auc"] < 0.5 and all(got[v]["pr_auc"] > 0.9 and got[v]["p_at_r70"] > 0.9 and got[v]["cost_per_1000"] < got["A"]["cost_per_1000"] for v in "BC")


def test_empty_fold(spark):
    with pytest.raises(ValueError, match="cal"):
        feature_choice.featureset_experiment(_frame(spark)[1].where("month <> 9"), ["value_inr", "item_count"])
