"""Choice of a feature set by what it costs in later months, without a look at the test period.

Each set is fitted on the first months, calibrated on the next one, priced on the months after it. Its bands
come from the calibration month, so that the price includes their transfer in time. Rings don't cross folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import feature_set
from ..operators.graph import stored
from . import costs, metrics, model, splits

VARIANTS = {"A": "plain", "B": "all", "C": "stable"}
RECALL = 0.7


def month_number(ts: str, start: str) -> Column:
    """Calendar months from the month of ``start``, which is 1."""
    return (F.year(ts) - F.year(start)) * 12 + F.month(ts) - F.month(start) + 1


def month_folds(frame: DataFrame, fit: int = 8, calibrate: int = 9, select: int = 12) -> dict[str, DataFrame]:
    """Rows of months 1 to ``fit``, up to ``calibrate`` and up to ``select``; later folds without rings of earlier ones."""
    first = frame.where(F.col("month").between(1, fit))
    cal = splits.drop_crossing_groups(frame.where(F.col("month").between(fit + 1, calibrate)), first)
    sel = splits.drop_crossing_groups(frame.where(F.col("month").between(calibrate + 1, select)), frame.where(F.col("month").between(1, calibrate)))
    return {"fit": first, "cal": cal, "sel": sel}


def _ranking(scored: DataFrame, positives: int) -> DataFrame:
    """One row: pr_auc and the precision at RECALL; null where there is no positive."""
    if not positives:
        return scored.sparkSession.createDataFrame([(None, None)], "pr_auc double, p_at_r70 double")
    at = metrics.precision_at_recall(scored, (RECALL,)).agg(F.max("precision").alias("p_at_r70"))
    return metrics.pr_auc(scored).crossJoin(at)  # one row each


def _bands(scored: DataFrame) -> tuple[float, float]:
    """The band of ``costs.select_policy``, without the single thresholds that go unused here."""
    feasible = costs.band_sweep(scored).where(F.col("review_share") <= costs.COST.capacity)
    if not (best := feasible.orderBy("cost_per_1000", "lo", "hi").select("lo", "hi").first()):
        raise ValueError("no band keeps within the review capacity")
    return best["lo"], best["hi"]


def featureset_experiment(frame: DataFrame, columns: list[str], variants: dict[str, str] = VARIANTS, trees: int = 60, **months: int) -> DataFrame:
    """A row for each variant: fold sizes, ranking and policy figures of the selection months, bands, and which is cheapest.

    ``frame`` has a row an order: order_id, month, ring_id, is_abuse, value_inr and ``columns``. Ties go to the
    first variant by name. ValueError where a fold is empty or no band keeps within the review capacity.
    """
    folds = month_folds(frame, **months)
    # In order of id, as sampling goes by place.
    folds = {k: stored(f.select("order_id", "is_abuse", *dict.fromkeys(["value_inr", *columns])).orderBy("order_id"), f"fold-{k}") for k, f in folds.items()}
    size = {k: f.agg(F.count("*"), F.coalesce(F.sum("is_abuse"), F.lit(0))).first() for k, f in folds.items()}
    if empty := [k for k, (n, _) in size.items() if not n]:
        raise ValueError(f"folds without rows: {empty}")
    positives = size["sel"][1]
    out = None
    for variant, name in variants.items():
        own = feature_set(columns, name)
        fitted = model.train_scorer(folds["fit"], own, trees=trees)
        raw = {k: stored(model.raw_scores(fitted, folds[k], own).select("order_id", "is_abuse", "value_inr", "raw_p"), f"raw-{k}") for k in ("cal", "sel")}
        iso = model.calibrate(raw["cal"])
        cal, sel = (stored(iso.transform(raw[k]).withColumnRenamed("prediction", "p"), f"scored-{k}") for k in ("cal", "sel"))
        lo, hi = _bands(cal)
        caught, acted = F.col("tp"), F.col("tp") + F.col("fp")
        row = costs.policy_cost(sel, lo, hi).crossJoin(_ranking(sel, positives)).select(
            F.lit(variant).alias("variant"), F.lit(len(own)).alias("n_features"), *[F.lit(size[k][0]).cast("long").alias(f"{k}_n") for k in folds],
            F.lit(positives / size["sel"][0]).alias("sel_base_rate"), "pr_auc", "p_at_r70", F.when(acted > 0, caught / acted).otherwise(0.0).alias("precision"),
            (caught / max(positives, 1)).alias("recall"), "review_share", "cost_per_1000", F.lit(lo).alias("band_lo"), F.lit(hi).alias("band_hi"),
        )
        out = row if out is None else out.unionByName(row)
    out = stored(out, "featuresets")
    best = out.agg(F.min(F.struct("cost_per_1000", "variant"))["variant"].alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("variant") == F.col("best")).drop("best")
