"""Costs, policy, metrics, splits and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import band
from ..operators import asof, features, graph
from ..plans import costs, feature_choice, integrity, metrics, splits
from ..sources import contract
from ..sources.driver_tables import CTES, world
from .asof_queries import _EDGE, BASE, CATEGORIES, _inputs, _o, _rounded, component_sql

LO, HI = 0.034, 0.344
BOUNDARY = "1999-01-01"
_CUT = 915148800


def _scored(spark, sf_dir):
    return world(spark, sf_dir)["scored"]


def _truth(spark, sf_dir):
    return world(spark, sf_dir)["truth"]


def band_of(spark, sf_dir):
    return _scored(spark, sf_dir).select("order_id", band("p", LO, HI).alias("band"))


def batch_view(spark, sf_dir):
    """Review batch: some bands, categories, values; the 600 highest scores (ties: order_id)."""
    s = _scored(spark, sf_dir).withColumn("band", band("p", LO, HI))
    s = s.where(F.col("band").isin("review", "auto_action") & (F.col("p") >= 0.05) & F.col("category").isin("PROMO", "SMALL", "LARGE") & F.col("value_inr").between(1000, 400000))
    return s.orderBy(F.desc("p"), "order_id").limit(600).select("order_id", "p", "band")


def review_queue(spark, sf_dir):
    s = _scored(spark, sf_dir).where(band("p", LO, HI) == "review")
    return s.select("order_id", "p", "value_inr").orderBy(F.desc("p"), "order_id")


def review_queue_stats(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("q", F.when(band("p", LO, HI) == "review", 1).otherwise(0))
    return _rounded(s.agg(F.sum("q").alias("queue"), F.avg(F.col("q").cast("double")).alias("share"), (F.sum(F.col("q") * F.col("is_abuse")) / F.sum("q")).alias("hit_rate")))


def order_costs(spark, sf_dir):
    return _rounded(costs.order_costs(world(spark, sf_dir)["orders"]), 3)


def policy_cost(spark, sf_dir):
    return _rounded(costs.policy_cost(_scored(spark, sf_dir), LO, HI), 3)


def baseline_costs(spark, sf_dir):
    return _rounded(costs.baseline_costs(_scored(spark, sf_dir)), 3)


def cost_curve(spark, sf_dir):
    return _rounded(costs.cost_curve(_scored(spark, sf_dir)).select("threshold", "cost_per_1000", "tp", "fp", "fn"), 3)


def band_sweep(spark, sf_dir):
    return _rounded(costs.band_sweep(_scored(spark, sf_dir)).select("lo", "hi", "cost_per_1000", "review_share", "tp", "fp", "fn"), 3)


def select_policy(spark, sf_dir):
    return _rounded(costs.select_policy(_scored(spark, sf_dir)), 3)


def cost_sensitivity(spark, sf_dir):
    s = costs.cost_sensitivity(_scored(spark, sf_dir), LO, HI)
    return _rounded(s.select("knob", "setting", "band_lo", "band_hi", "review_share", "cost_reselected", "cost_as_shipped", "cost_single", "cost_do_nothing", "cost_block_all", "beats_single", "beats_nothing", "shipped_beats_single", "shipped_beats_nothing", "regret", "band_survives"), 3)


def sensitivity_verdict(spark, sf_dir):
    return _rounded(costs.sensitivity_verdict(costs.cost_sensitivity(_scored(spark, sf_dir), LO, HI)), 3)


def pr_auc(spark, sf_dir):
    return _rounded(metrics.pr_auc(_scored(spark, sf_dir)), 6)


def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(_scored(spark, sf_dir)), 6)


def brier(spark, sf_dir):
    return _rounded(metrics.brier(_scored(spark, sf_dir)), 6)


def precision_at_recall(spark, sf_dir):
    return _rounded(metrics.precision_at_recall(_scored(spark, sf_dir)), 6)


def reliability_bins(spark, sf_dir):
    return _rounded(metrics.reliability_bins(_scored(spark, sf_dir)), 6)


def recall_by_ring_type(spark, sf_dir):
    return _rounded(metrics.recall_by_ring_type(_scored(spark, sf_dir), LO, HI), 6)


def fp_by_population(spark, sf_dir):
    return _rounded(metrics.fp_by_population(_scored(spark, sf_dir), LO, HI), 6)


def evaluation_summary(spark, sf_dir):
    return _rounded(metrics.evaluation_summary(_scored(spark, sf_dir), LO, HI), 4)


def evaluation_summary_true(spark, sf_dir):
    """The ceiling: the same scores against the true labels."""
    return _rounded(metrics.evaluation_summary(_scored(spark, sf_dir), LO, HI, label="is_abuse_true"), 4)


def compare_runs(spark, sf_dir):
    s = _scored(spark, sf_dir)
    one, two = (costs.policy_cost(s, LO, HI, label=x) for x in ("is_abuse", "is_abuse_true"))
    return _rounded(metrics.compare_runs(one, two), 3)


def dataset_stats(spark, sf_dir):
    t = _truth(spark, sf_dir)
    cod = F.col("payment_mode") == "COD"
    return _rounded(t.agg(
        F.count("*").alias("n_orders"), F.countDistinct("customer_id").alias("n_customers"), F.avg(cod.cast("double")).alias("cod_share"),
        F.avg(F.col("is_abuse").cast("double")).alias("abuse_rate"), F.avg(F.when(cod, F.col("is_abuse").cast("double"))).alias("cod_abuse_rate"),
        F.sum((F.col("ring_id") >= 0).cast("int")).alias("ring_orders"), F.avg(F.col("is_abuse_true").cast("double")).alias("true_abuse_rate"),
        F.sum(cod.cast("int")).alias("cod_orders"), F.sum("is_abuse").alias("abuse_orders"), F.sum("is_abuse_true").alias("true_abuse_orders"),
        F.avg(F.when(cod, F.col("is_abuse_true").cast("double"))).alias("cod_true_abuse_rate"), F.avg(F.when(~cod, F.col("is_abuse_true").cast("double"))).alias("prepaid_true_abuse_rate"),
        F.sum(F.when(~cod, F.col("is_abuse_true")).otherwise(0)).alias("prepaid_true_abuse_orders"),
    ), 6).crossJoin(customer_base_rate(spark, sf_dir).withColumnsRenamed({"all_rate": "customer_rate", "cod_active_rate": "cod_customer_rate"})).crossJoin(  # one row each
        _counts(t.join(splits.group_split(t), "group_key"), "split", "split_counts")
    ).crossJoin(_counts(_folds(spark, sf_dir)[1], "split", "temporal_counts")).crossJoin(_counts(t.where("is_abuse_true = 1"), "ring_type", "ring_type_orders"))


def _counts(rows, by, name):
    """One row, one text: the number of rows of each value, in order of the value. Few values."""
    n = rows.groupBy(by).count().select(F.struct(F.col(by).alias("k"), F.concat_ws("=", by, F.col("count").cast("string")).alias("v")).alias("x"))
    return n.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), ",").alias(name))


def monthly_profile(spark, sf_dir):
    t = _truth(spark, sf_dir)
    return _rounded(t.groupBy(F.date_format(F.date_trunc("month", "order_ts"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.avg(F.col("is_abuse").cast("double")).alias("abuse_rate")), 6)


def customer_base_rate(spark, sf_dir):
    t = _truth(spark, sf_dir)
    c = t.groupBy("customer_id").agg(F.max("is_abuse").alias("bad"), F.max((F.col("payment_mode") == "COD").cast("int")).alias("cod"))
    return _rounded(c.agg(F.avg(F.col("bad").cast("double")).alias("all_rate"), F.avg(F.when(F.col("cod") == 1, F.col("bad").cast("double"))).alias("cod_active_rate")), 6)


def _folds(spark, sf_dir):
    t = _truth(spark, sf_dir)
    return t, splits.temporal_split(t, F.lit(BOUNDARY).cast("timestamp"))


def temporal_split(spark, sf_dir):
    return _folds(spark, sf_dir)[1]


def drop_crossing_groups(spark, sf_dir):
    t = _truth(spark, sf_dir)
    cut = F.lit(BOUNDARY).cast("timestamp")
    return splits.drop_crossing_groups(t.where(F.col("order_ts") >= cut), t.where(F.col("order_ts") < cut)).select("order_id")


def group_split(spark, sf_dir):
    return splits.group_split(_truth(spark, sf_dir))


def carve_validation(spark, sf_dir):
    return splits.carve_validation(_truth(spark, sf_dir))


def dataset_fingerprint(spark, sf_dir):
    """The held-out set: orders of the groups in the test split."""
    return splits.fingerprint(_held(spark, sf_dir), "order_id")


def _held(spark, sf_dir):
    t = _truth(spark, sf_dir)
    return t.join(splits.group_split(t).where("split = 'test'"), "group_key").select("order_id", "customer_id", "payment_mode", "category", "is_abuse")


def verify_fingerprint(spark, sf_dir):
    """The held-out set against a copy with planted changes: a label turned, orders lost, an order too many; by its tree of digests."""
    held = graph.stored(_held(spark, sf_dir), "held")
    now = held.where("order_id % 977 <> 5").withColumn("is_abuse", F.expr("if(order_id % 1013 = 7, 1 - is_abuse, is_abuse)"))
    now = now.unionByName(held.where("order_id % 2003 = 9").withColumn("order_id", -F.col("order_id")))
    return integrity.changed_ids(integrity.DigestTree(held, "order_id"), integrity.DigestTree(now, "order_id"), spark)


def input_contract(spark, sf_dir):
    """How many rows of each input break which rule of its contract."""
    w = world(spark, sf_dir)
    return contract.report({name: contract.reasons(name, w[name]) for name in contract.CONTRACT})


def unseen_customer_share(spark, sf_dir):
    """Share of label-0 test orders from customers without a train order, and the median of their tenure."""
    t, s = _folds(spark, sf_dir)
    t = t.join(s, "order_id").join(world(spark, sf_dir)["customers"], "customer_id")
    seen = t.where("split = 'train'").select("customer_id", F.lit(1).alias("seen")).distinct()
    test = t.where("split = 'test' AND is_abuse = 0").join(seen, "customer_id", "left")
    days = (F.unix_seconds("order_ts") - F.unix_seconds("signup_ts")) / 86400
    median = asof.exact_quantiles(test.select(days.alias("days")), "days", [0.5]).select(F.get("q", F.lit(0)).alias("median_tenure"))
    return _rounded(test.agg(F.avg(F.when(F.col("seen").isNull(), 1.0).otherwise(0.0)).alias("unseen_share")).join(median, how="left"))  # one row each


def fp_profile(spark, sf_dir):
    """False positives of the action band in the test period: how many, from unseen customers, median value, tenure, component's size and growth."""
    t, s = _folds(spark, sf_dir)
    seen = t.join(s, "order_id").where("split = 'train'").select("customer_id", F.lit(1).alias("seen")).distinct()
    test = _scored(spark, sf_dir).join(s.where("split = 'test'"), "order_id").where((F.col("is_abuse") == 0) & (F.col("p") >= HI)).join(seen, "customer_id", "left")
    test = test.join(world(spark, sf_dir)["customers"], "customer_id", "left")
    test = test.withColumn("days", F.greatest((F.unix_seconds("order_ts") - F.unix_seconds("signup_ts")) / 86400, F.lit(0.0)))
    out = test.agg(F.count("*").alias("n"), F.avg(F.when(F.col("seen").isNull(), 1.0).otherwise(0.0)).alias("unseen_share"))
    w, o = _o(spark, sf_dir)
    comp = graph.component_features(o, w["returns"], w["customers"], graph.stored(graph.identity_edges(o, w["phones"]), "edges"))
    test = graph.stored(test.join(comp.select("order_id", "comp_size", "comp_growth_d7"), "order_id"), "false-positives")
    for c, name in (("value_inr", "median_value"), ("days", "median_tenure"), ("comp_size", "median_comp_size"), ("comp_growth_d7", "median_comp_growth")):
        out = out.join(asof.exact_quantiles(test, c, [0.5]).select(F.get("q", F.lit(0)).alias(name)), how="left")  # one row each
    return _rounded(out)


def _months_frame(spark, sf_dir, months: int = 12):
    """COD orders of the first months with label, ring, number of the month and all features; and the features' names.

    No feature reads the future, so the orders after these months are left out before the features are made.
    """
    w = world(spark, sf_dir)
    start = F.date_trunc("month", F.min("order_ts"))
    start, end = w["orders"].agg(F.unix_seconds(start), F.unix_seconds(F.add_months(start, months).cast("timestamp"))).first()
    cut = features.prefix_truncate(w, F.timestamp_seconds(F.lit(end)))
    f = graph.stored(features.build_features(**_inputs(cut), categories=CATEGORIES), "features")
    t = w["truth"].where("payment_mode = 'COD'").where(F.col("order_ts") < F.timestamp_seconds(F.lit(end))).withColumn("start", F.timestamp_seconds(F.lit(start)))
    t = t.select("order_id", "ring_id", "is_abuse", feature_choice.month_number("order_ts", "start").alias("month"))
    return graph.stored(t.join(f, "order_id"), "months"), [c for c in f.columns if c != "order_id"]


def featureset_experiment(spark, sf_dir):
    """Each feature set fitted on months 1-8, calibrated and given its bands on 9, priced on 10-12, and which is cheapest."""
    return _rounded(feature_choice.featureset_experiment(*_months_frame(spark, sf_dir)), 4)


QUERIES = {f.__name__: f for f in (
    band_of, batch_view, review_queue, review_queue_stats, order_costs, policy_cost, baseline_costs, cost_curve, band_sweep, select_policy, cost_sensitivity,
    sensitivity_verdict, pr_auc, roc_auc, brier, precision_at_recall, reliability_bins, recall_by_ring_type, fp_by_population, evaluation_summary, evaluation_summary_true, compare_runs,
    dataset_stats, monthly_profile, customer_base_rate, temporal_split, drop_crossing_groups, group_split, carve_validation, dataset_fingerprint,
    unseen_customer_share, fp_profile, featureset_experiment, verify_fingerprint, input_contract,
)}

_BAND = f"CASE WHEN p >= {HI} THEN 'auto_action' WHEN p >= {LO} THEN 'review' ELSE 'pass' END"


def _policy(lo: str, hi: str, label: str = "is_abuse", p: str = "p") -> dict[str, str]:
    miss, alarm = "(200 + 0.72 * value_inr)", "(0.0612 * value_inr + 319)"
    each = (f"CASE WHEN {p} < {lo} AND {label} = 1 THEN {miss} WHEN {p} >= {hi} AND {label} = 0 THEN {alarm} WHEN {p} >= {lo} AND {p} < {hi} THEN 32 + 0.12 * "
            f"CASE WHEN {label} = 1 THEN {miss} ELSE {alarm} END ELSE 0 END::DOUBLE")  # fmt: skip
    return {
        "total_cost": f"round(sum({each}), 3)", "cost_per_1000": f"round(avg({each}) * 1000, 3)", "pass_share": f"round(avg(CASE WHEN {p} < {lo} THEN 1.0 ELSE 0 END), 3)",
        "review_share": f"round(avg(CASE WHEN {p} >= {lo} AND {p} < {hi} THEN 1.0 ELSE 0 END), 3)", "action_share": f"round(avg(CASE WHEN {p} >= {hi} THEN 1.0 ELSE 0 END), 3)",
        "n_review": f"count(*) FILTER (WHERE {p} >= {lo} AND {p} < {hi})", "tp": f"count(*) FILTER (WHERE {p} >= {hi} AND {label} = 1)",
        "fp": f"count(*) FILTER (WHERE {p} >= {hi} AND {label} = 0)", "fn": f"count(*) FILTER (WHERE {p} < {lo} AND {label} = 1)",
        "tn": f"count(*) FILTER (WHERE {p} < {lo} AND {label} = 0)", "caught_in_review": f"count(*) FILTER (WHERE {p} >= {lo} AND {p} < {hi} AND {label} = 1)",
    }


def _cols(d: dict[str, str], names: list[str] | None = None) -> str:
    return ", ".join(f"{d[n]} AS {n}" for n in names or d)


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else f"'{x}'" for x in r) + ")" for r in rows) + ")"


# Sums by score, then every band or threshold against them: few hundred scores at most.
_H = CTES + ", h AS (SELECT p, sum(is_abuse) AS pos, sum(1 - is_abuse) AS neg, sum(value_inr * is_abuse) AS vp, sum(value_inr * (1 - is_abuse)) AS vn FROM scored GROUP BY p)"
_TOTAL = "sum(CASE WHEN p < lo THEN {ff} * pos + {fv} * vp WHEN p >= hi THEN {af} * neg + {av} * vn ELSE {rv} * (pos + neg) + (1 - {ac}) * ({ff} * pos + {fv} * vp + {af} * neg + {av} * vn) END)"
_STD = {"ff": "200.0::DOUBLE", "fv": "0.72::DOUBLE", "af": "319.0::DOUBLE", "av": "0.0612::DOUBLE", "rv": "32.0::DOUBLE", "ac": "0.88::DOUBLE"}
_GRID = lambda n: _values([(float(a), float(b)) for a in costs.np.linspace(*costs.LO_RANGE, n) for b in costs.np.linspace(*costs.HI_RANGE, n) if b > a]) + " AS g(lo, hi)"
_FIG = "{total} / sum(pos + neg) * 1000 AS cost_per_1000, sum(CASE WHEN p >= lo AND p < hi THEN pos + neg ELSE 0 END)::DOUBLE / sum(pos + neg) AS review_share, sum(CASE WHEN p >= hi THEN pos ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p >= hi THEN neg ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN p < lo THEN pos ELSE 0 END)::BIGINT AS fn"
_T = "t AS (SELECT DISTINCT least(greatest(x, 0), 1)::DOUBLE AS lo FROM (SELECT unnest(quantile_cont(p, [" + ", ".join(repr(float(x)) for x in costs.np.linspace(0, 1, 400)) + "])) AS x FROM scored UNION ALL SELECT 0.0 UNION ALL SELECT 1.0))"
_CURVE = "c AS (SELECT lo, " + _FIG.format(total=_TOTAL.format(**_STD)) + " FROM (SELECT lo, lo AS hi FROM t), h GROUP BY lo, hi)"
_SWEEP = "s AS (SELECT lo, hi, " + _FIG.format(total=_TOTAL.format(**_STD)) + f" FROM {_GRID(60)}, h GROUP BY lo, hi)"
_TH = CTES + ", tt AS (SELECT sum(is_abuse) AS tp_, sum(1 - is_abuse) AS tn_ FROM scored), g AS (SELECT p, sum(is_abuse) AS pos, sum(1 - is_abuse) AS neg FROM scored GROUP BY p), k AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS ap, sum(neg) OVER (ORDER BY p DESC) AS an, tp_, tn_ FROM g, tt)"
_AP = "(SELECT sum(pos::DOUBLE / tp_ * ap / (ap + an)) FROM k)"
_ROC = "(SELECT sum(pos * (tn_ - (an - neg) - neg + neg / 2.0))::DOUBLE / max(tp_ * tn_) FROM k)"
_Q = "[" + ", ".join(repr(float(x)) for x in costs.np.linspace(0, 1, 13)) + "]"
_BINS = f"e AS (SELECT list_sort(list_distinct(quantile_cont(p, {_Q}))) AS q FROM scored), b AS (SELECT p, is_abuse, len(list_filter(q[2:-2], lambda x: x <= p)) AS bin FROM scored, e), bb AS (SELECT bin::INTEGER AS bin, count(*) AS n, avg(p) AS mp, avg(is_abuse) AS ob FROM b GROUP BY bin)"
_SPLIT = f"sp AS (SELECT order_id, customer_id, CASE WHEN ts_sec < {_CUT} THEN 'train' WHEN ring_id >= 0 AND min(ts_sec) OVER (PARTITION BY ring_id) < {_CUT} THEN 'drop' ELSE 'test' END AS split FROM truth)"
_GROUPS = "WITH k AS (SELECT DISTINCT group_key FROM truth), r AS (SELECT group_key, (row_number() OVER (ORDER BY left(md5('7|' || group_key), 13), group_key) - 1)::DOUBLE / count(*) OVER () AS s FROM k), gs AS (SELECT group_key, CASE WHEN s < 0.6 THEN 'train' WHEN s < 0.6 + 0.2 THEN 'val' ELSE 'test' END AS split FROM r)"
_ALL = _policy(str(LO), str(HI))
_TRUE = _policy(str(LO), str(HI), "is_abuse_true")
_WORLDS = ("w AS (SELECT * FROM " + _values([(k, s, c.fn_fixed, float(c.loss), c.fp_fixed, c.fp_rate, c.review, float(c.accuracy), float(c.capacity)) for k, s, c in costs.worlds()])
           + " AS w(knob, setting, ff, fv, af, av, rv, ac, cap))")
_Q200 = "[" + ", ".join(repr(float(x)) for x in costs.np.linspace(0, 1, 200)) + "]"
_WT = _TOTAL.format(ff="ff", fv="fv", af="af", av="av", rv="rv", ac="ac")

SQL = {
    "band_of": CTES + f"SELECT order_id, {_BAND} AS band FROM scored",
    "batch_view": CTES + f"SELECT order_id, p, {_BAND} AS band FROM scored WHERE p >= {LO} AND p >= 0.05 AND category IN ('PROMO', 'SMALL', 'LARGE') AND value_inr BETWEEN 1000 AND 400000 ORDER BY p DESC, order_id LIMIT 600",
    "review_queue": CTES + f"SELECT order_id, p, value_inr FROM scored WHERE p >= {LO} AND p < {HI}",
    "review_queue_stats": CTES + f", q AS (SELECT is_abuse, CASE WHEN p >= {LO} AND p < {HI} THEN 1 ELSE 0 END AS q FROM scored) SELECT sum(q)::BIGINT AS queue, round(avg(q), 5) AS share, round(sum(q * is_abuse)::DOUBLE / sum(q), 5) AS hit_rate FROM q",
    "order_costs": CTES + "SELECT order_id, round(200 + 0.72::DOUBLE * value_inr, 3) AS miss_cost, round(0.0612::DOUBLE * value_inr + 319, 3) AS alarm_cost, 32.0::DOUBLE AS review_cost FROM ords",
    "policy_cost": CTES + f"SELECT {_cols(_ALL)} FROM scored",
    "baseline_costs": CTES + "SELECT round(sum(CASE WHEN is_abuse = 1 THEN 200 + 0.72::DOUBLE * value_inr ELSE 0 END), 3) AS do_nothing_total, round(avg(CASE WHEN is_abuse = 1 THEN 200 + 0.72::DOUBLE * value_inr ELSE 0 END) * 1000, 3) AS do_nothing_per_1000, round(sum(CASE WHEN is_abuse = 0 THEN 0.0612::DOUBLE * value_inr + 319 ELSE 0 END), 3) AS block_all_total, round(avg(CASE WHEN is_abuse = 0 THEN 0.0612::DOUBLE * value_inr + 319 ELSE 0 END) * 1000, 3) AS block_all_per_1000 FROM scored",
    "cost_curve": _H + f", {_T}, {_CURVE} SELECT round(lo, 3) AS threshold, round(cost_per_1000, 3) AS cost_per_1000, tp, fp, fn FROM c",
    "band_sweep": _H + f", {_SWEEP} SELECT round(lo, 3) AS lo, round(hi, 3) AS hi, round(cost_per_1000, 3) AS cost_per_1000, round(review_share, 3) AS review_share, tp, fp, fn FROM s",
    "select_policy": _H + f", {_T}, {_CURVE}, {_SWEEP}, n AS (SELECT sum(CASE WHEN is_abuse = 1 THEN 200 + 0.72::DOUBLE * value_inr ELSE 0 END) / count(*) * 1000 AS dn, sum(CASE WHEN is_abuse = 0 THEN 0.0612::DOUBLE * value_inr + 319 ELSE 0 END) / count(*) * 1000 AS ba FROM scored), bb AS (SELECT * FROM s WHERE review_share <= 0.05 ORDER BY cost_per_1000, lo, hi LIMIT 1), cc AS (SELECT lo AS t, cost_per_1000 AS c FROM c ORDER BY c, t LIMIT 1), aa AS (SELECT avg(CASE WHEN p >= hi THEN 1.0 ELSE 0 END) AS a FROM scored, bb) SELECT round(lo, 3) AS band_lo, round(hi, 3) AS band_hi, round(cost_per_1000, 3) AS band_cost_per_1000, round(review_share, 3) AS band_review_share, round(a, 3) AS band_action_share, round(t, 3) AS single_threshold, round(c, 3) AS single_cost_per_1000, round(dn, 3) AS do_nothing_per_1000, round(ba, 3) AS block_all_per_1000, round(dn - cost_per_1000, 3) AS saving_per_1000, round(100 * (dn - cost_per_1000) / dn, 3) AS saving_pct FROM bb, cc, aa, n",
    "cost_sensitivity": _H + f", {_WORLDS}, a AS (SELECT knob, setting, lo, hi, {_WT} / sum(pos + neg) * 1000 AS c, sum(CASE WHEN p >= lo AND p < hi THEN pos + neg ELSE 0 END)::DOUBLE / sum(pos + neg) AS rs, any_value(cap) AS cap FROM {_GRID(40)}, w, h GROUP BY knob, setting, lo, hi), b AS (SELECT * FROM a WHERE rs <= cap QUALIFY row_number() OVER (PARTITION BY knob, setting ORDER BY c, lo, hi) = 1), tc AS (SELECT DISTINCT least(greatest(x, 0), 1)::DOUBLE AS lo FROM (SELECT unnest(quantile_cont(p, {_Q200})) AS x FROM scored UNION ALL SELECT 0.0 UNION ALL SELECT 1.0)), sg AS (SELECT knob, setting, min(c) AS c FROM (SELECT knob, setting, lo, {_WT} / sum(pos + neg) * 1000 AS c FROM (SELECT lo, lo AS hi FROM tc), w, h GROUP BY knob, setting, lo, hi) GROUP BY knob, setting), z AS (SELECT knob, setting, lo, {_WT} / sum(pos + neg) * 1000 AS c FROM (VALUES ({LO}, {HI}), (2.0, 2.0), (-1.0, -1.0)) AS v(lo, hi), w, h GROUP BY knob, setting, lo, hi) SELECT b.knob, b.setting, round(b.lo, 3) AS band_lo, round(b.hi, 3) AS band_hi, round(rs, 3) AS review_share, round(b.c, 3) AS cost_reselected, round(z1.c, 3) AS cost_as_shipped, round(z2.c, 3) AS cost_do_nothing, round(z3.c, 3) AS cost_block_all, b.c < z2.c AS beats_nothing, round(sg.c, 3) AS cost_single, b.c < sg.c AS beats_single, z1.c < sg.c AS shipped_beats_single, z1.c < z2.c AS shipped_beats_nothing, round(z1.c - b.c, 3) AS regret, b.lo < b.hi AND rs > 0.0005 AS band_survives FROM b JOIN sg ON sg.knob = b.knob AND sg.setting = b.setting JOIN z z1 ON z1.knob = b.knob AND z1.setting = b.setting AND z1.lo = {LO} JOIN z z2 ON z2.knob = b.knob AND z2.setting = b.setting AND z2.lo = 2 JOIN z z3 ON z3.knob = b.knob AND z3.setting = b.setting AND z3.lo = -1",
    "pr_auc": _TH + f"SELECT round({_AP}, 6) AS pr_auc",
    "roc_auc": _TH + f"SELECT round({_ROC}, 6) AS roc_auc",
    "brier": CTES + "SELECT round(avg((p - is_abuse) * (p - is_abuse)), 6) AS brier FROM scored",
    "precision_at_recall": _TH + "SELECT level::DOUBLE AS level, max(p) AS threshold, round(arg_max(ap::DOUBLE / (ap + an), p), 6) AS precision FROM k, (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)) AS l(level) WHERE ap::DOUBLE / tp_ >= level GROUP BY level",
    "reliability_bins": CTES + f", {_BINS} SELECT bin, n, round(mp, 6) AS mean_pred, round(ob, 6) AS observed FROM bb",
    "recall_by_ring_type": CTES + f"SELECT ring_type, count(*) AS n, round(avg(CASE WHEN p >= {HI} THEN 1.0 ELSE 0 END), 6) AS action_share, round(avg(CASE WHEN p >= {LO} AND p < {HI} THEN 1.0 ELSE 0 END), 6) AS review_share, round(avg(CASE WHEN p < {LO} THEN 1.0 ELSE 0 END), 6) AS missed_share, round(avg(CASE WHEN p >= {LO} THEN 1.0 ELSE 0 END), 6) AS recall_with_review, round(quantile_cont(p, 0.5), 6) AS median_score FROM scored WHERE is_abuse = 1 GROUP BY ring_type",
    "fp_by_population": CTES + f"SELECT coalesce(hn_type, 'none') AS population, count(*) AS n, round(avg(CASE WHEN p >= {HI} THEN 1.0 ELSE 0 END), 6) AS fp_rate, round(avg(CASE WHEN p >= {LO} AND p < {HI} THEN 1.0 ELSE 0 END), 6) AS review_rate, count(*) FILTER (WHERE p >= {HI}) AS n_fp, round(quantile_cont(p, 0.5), 6) AS median_score FROM scored WHERE is_abuse = 0 GROUP BY 1",
    "evaluation_summary": _TH + f", {_BINS}, m AS (SELECT count(*) AS n, sum(is_abuse)::BIGINT AS positives, avg(is_abuse) AS br, count(*) FILTER (WHERE p >= {HI} AND is_abuse = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p >= {HI}) AS na, avg((p - is_abuse) * (p - is_abuse)) AS bs, {_ALL['cost_per_1000'].replace(', 3)', ', 12)')} AS c, avg(CASE WHEN p >= {LO} AND p < {HI} THEN 1.0 ELSE 0 END) AS rs, {_policy(str(HI), str(HI))['cost_per_1000'].replace(', 3)', ', 12)')} AS sc, avg(CASE WHEN is_abuse = 1 THEN 200 + 0.72::DOUBLE * value_inr ELSE 0 END) * 1000 AS dn, avg(CASE WHEN is_abuse = 0 THEN 0.0612::DOUBLE * value_inr + 319 ELSE 0 END) * 1000 AS ba FROM scored) SELECT n, positives, round(br, 4) AS base_rate, round(tp / greatest(na, 1), 4) AS precision, round(tp / greatest(positives, 1), 4) AS recall, round({_AP}, 4) AS pr_auc, round({_ROC}, 4) AS roc_auc, round(bs, 4) AS brier, round((SELECT sum(n * abs(mp - ob)) / sum(n) FROM bb), 4) AS ece, round(c, 4) AS cost_per_1000, round(rs, 4) AS review_share, round(sc, 4) AS single_cost_per_1000, round(dn, 4) AS do_nothing_per_1000, round(ba, 4) AS block_all_per_1000, round(dn - c, 4) AS saving_per_1000 FROM m",
    "compare_runs": CTES + f", a AS (SELECT {_cols(_ALL).replace(', 3)', ', 9)')} FROM scored), b AS (SELECT {_cols(_TRUE).replace(', 3)', ', 9)')} FROM scored) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(a.{m}::DOUBLE, 3) AS first, round(b.{m}::DOUBLE, 3) AS second, round(b.{m}::DOUBLE - a.{m}::DOUBLE, 3) AS delta FROM a, b" for m in _ALL),
    "dataset_stats": CTES + "SELECT count(*) AS n_orders, count(DISTINCT customer_id) AS n_customers, round(avg(CASE WHEN payment_mode = 'COD' THEN 1.0 ELSE 0 END), 6) AS cod_share, round(avg(is_abuse), 6) AS abuse_rate, round(avg(is_abuse) FILTER (WHERE payment_mode = 'COD'), 6) AS cod_abuse_rate, count(*) FILTER (WHERE ring_id >= 0) AS ring_orders, round(avg(is_abuse_true), 6) AS true_abuse_rate, count(*) FILTER (WHERE payment_mode = 'COD') AS cod_orders, sum(is_abuse)::BIGINT AS abuse_orders, sum(is_abuse_true)::BIGINT AS true_abuse_orders, round(avg(is_abuse_true) FILTER (WHERE payment_mode = 'COD'), 6) AS cod_true_abuse_rate, round(avg(is_abuse_true) FILTER (WHERE payment_mode <> 'COD'), 6) AS prepaid_true_abuse_rate, (sum(is_abuse_true) FILTER (WHERE payment_mode <> 'COD'))::BIGINT AS prepaid_true_abuse_orders, (SELECT round(avg(bad), 6) FROM (SELECT max(is_abuse) AS bad FROM truth GROUP BY customer_id)) AS customer_rate, (SELECT round(avg(bad), 6) FROM (SELECT max(is_abuse) AS bad FROM truth GROUP BY customer_id HAVING max(CASE WHEN payment_mode = 'COD' THEN 1 ELSE 0 END) = 1)) AS cod_customer_rate, (SELECT string_agg(split || '=' || n, ',' ORDER BY split) FROM (" + _GROUPS + " SELECT split, count(*) AS n FROM truth JOIN gs USING (group_key) GROUP BY split)) AS split_counts, (SELECT string_agg(split || '=' || n, ',' ORDER BY split) FROM (WITH " + _SPLIT + " SELECT split, count(*) AS n FROM sp GROUP BY split)) AS temporal_counts, (SELECT string_agg(ring_type || '=' || n, ',' ORDER BY ring_type) FROM (SELECT ring_type, count(*) AS n FROM truth WHERE is_abuse_true = 1 GROUP BY ring_type)) AS ring_type_orders FROM truth",
    "monthly_profile": CTES + "SELECT strftime(make_timestamp(ts_sec * 1000000), '%Y-%m') AS month, count(*) AS n, round(avg(is_abuse), 6) AS abuse_rate FROM truth GROUP BY 1",
    "customer_base_rate": CTES + ", c AS (SELECT customer_id, max(is_abuse) AS bad, max(CASE WHEN payment_mode = 'COD' THEN 1 ELSE 0 END) AS cod FROM truth GROUP BY 1) SELECT round(avg(bad), 6) AS all_rate, round(avg(bad) FILTER (WHERE cod = 1), 6) AS cod_active_rate FROM c",
    "temporal_split": CTES + f", {_SPLIT} SELECT order_id, split FROM sp",
    "drop_crossing_groups": CTES + f"SELECT order_id FROM truth WHERE ts_sec >= {_CUT} AND (ring_id < 0 OR ring_id NOT IN (SELECT ring_id FROM truth WHERE ts_sec < {_CUT}))",
    "group_split": CTES + "SELECT * FROM (" + _GROUPS + " SELECT * FROM gs)",
    "carve_validation": CTES + ", c AS (SELECT quantile_cont(ts_sec, 0.8) AS cut FROM truth) SELECT order_id, CASE WHEN ts_sec >= cut THEN 'val' ELSE 'train' END AS split FROM truth, c WHERE ts_sec >= cut OR group_key NOT IN (SELECT group_key FROM truth, c WHERE ts_sec >= cut)",
    "dataset_fingerprint": CTES + "SELECT order_id // 1000 AS range, count(*) AS n, sha256(string_agg(order_id::VARCHAR, ',' ORDER BY order_id)) AS digest, sha256(string_agg(sha256(concat_ws('|', order_id, customer_id, payment_mode, category, is_abuse)), ',' ORDER BY order_id)) AS rows_digest FROM truth JOIN (" + _GROUPS + " SELECT group_key FROM gs WHERE split = 'test') USING (group_key) GROUP BY 1",
    "unseen_customer_share": CTES + f", {_SPLIT} SELECT round(avg(CASE WHEN s.customer_id IS NULL THEN 1.0 ELSE 0 END), 5) AS unseen_share, round(quantile_cont((truth.ts_sec - signup_sec) / 86400.0, 0.5), 5)::DOUBLE AS median_tenure FROM truth JOIN sp ON sp.order_id = truth.order_id JOIN custs ON custs.customer_id = truth.customer_id LEFT JOIN (SELECT DISTINCT customer_id FROM sp WHERE split = 'train') s ON s.customer_id = truth.customer_id WHERE split = 'test' AND is_abuse = 0",
    "fp_profile": BASE + _EDGE + f", {_SPLIT}, fp AS MATERIALIZED (SELECT scored.*, device_id, cluster FROM scored JOIN sp ON sp.order_id = scored.order_id JOIN o ON o.order_id = scored.order_id WHERE split = 'test' AND is_abuse = 0 AND p >= {HI})"
    + component_sql("SELECT * FROM fp") + """, zz AS (SELECT order_id, count(*) AS z FROM members GROUP BY order_id)
SELECT count(*) AS n, round(avg(CASE WHEN s.customer_id IS NULL THEN 1.0 ELSE 0 END), 5) AS unseen_share, round(quantile_cont(fp.value_inr, 0.5), 5) AS median_value, round(quantile_cont(greatest((fp.ts_sec - signup_sec) / 86400.0::DOUBLE, 0), 0.5), 5) AS median_tenure,
  round(quantile_cont(z, 0.5), 5) AS median_comp_size, round(quantile_cont(coalesce(g, 0), 0.5), 5) AS median_comp_growth FROM fp JOIN custs ON custs.customer_id = fp.customer_id JOIN zz ON zz.order_id = fp.order_id LEFT JOIN grown ON grown.order_id = fp.order_id
  LEFT JOIN (SELECT DISTINCT customer_id FROM sp WHERE split = 'train') s ON s.customer_id = fp.customer_id""",
    "verify_fingerprint": CTES + ", h AS (SELECT order_id, customer_id, payment_mode, category, is_abuse FROM truth JOIN (" + _GROUPS + """ SELECT group_key FROM gs WHERE split = 'test') USING (group_key)),
now AS (SELECT order_id, customer_id, payment_mode, category, CASE WHEN order_id % 1013 = 7 THEN 1 - is_abuse ELSE is_abuse END AS is_abuse FROM h WHERE order_id % 977 <> 5
  UNION ALL SELECT -order_id, customer_id, payment_mode, category, is_abuse FROM h WHERE order_id % 2003 = 9)
SELECT coalesce(h.order_id, now.order_id) AS id, CASE WHEN h.order_id IS NULL THEN 'added' WHEN now.order_id IS NULL THEN 'missing' ELSE 'changed' END AS change
FROM h FULL JOIN now ON h.order_id = now.order_id WHERE h IS DISTINCT FROM now""",
    "input_contract": CTES + """, r AS (SELECT 'orders' AS input, ['rows'] || CASE WHEN item_count < 1 THEN ['rejected', 'item_count: below 1'] ELSE [] END AS m FROM ords
UNION ALL SELECT 'returns', ['rows'] FROM rets UNION ALL SELECT 'customers', ['rows'] FROM custs UNION ALL SELECT 'phones', ['rows'] FROM fones
UNION ALL SELECT 'addresses', ['rows'] || CASE WHEN pincode NOT BETWEEN 100000 AND 999999 THEN ['rejected', 'pincode'] ELSE [] END FROM doors)
SELECT input, reason, count(*) AS n FROM (SELECT input, unnest(m) AS reason FROM r) GROUP BY ALL""",
}
_SINGLE = SQL["cost_sensitivity"].replace("min(c) AS c FROM (", "min(c) AS c, first(lo ORDER BY c, lo) AS lo FROM (").replace("SELECT b.knob, b.setting,", "SELECT sg.lo AS single_threshold, b.knob, b.setting,")
SQL["sensitivity_verdict"] = f"""SELECT count(*) AS n_worlds, bool_and(beats_single) AS all_beat_single, bool_and(beats_nothing) AS all_beat_nothing, bool_and(shipped_beats_single) AS all_shipped_beat_single,
  bool_and(shipped_beats_nothing) AS all_shipped_beat_nothing, bool_and(band_survives) AS all_bands_survive, round(min(band_lo), 3) AS band_lo_min, round(max(band_lo), 3) AS band_lo_max, round(min(band_hi), 3) AS band_hi_min, round(max(band_hi), 3) AS band_hi_max,
  round(max(regret), 3) AS max_regret, round(min(single_threshold), 3) AS single_threshold_min, round(max(single_threshold), 3) AS single_threshold_max, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT band_survives), '') AS band_collapses,
  arg_max(name, regret) AS max_regret_world, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT beats_single), '') AS loses_to_single FROM (SELECT *, knob || ' ' || setting AS name FROM ({_SINGLE}))"""
SQL["evaluation_summary_true"] = CTES + SQL["evaluation_summary"][len(CTES) :].replace("is_abuse", "is_abuse_true")
