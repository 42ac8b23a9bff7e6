"""Ranking, calibration and segment metrics, all from tables grouped by score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band
from ..operators.asof import exact_quantiles
from .costs import SCORE_WIDTH, at_or_above, baseline_costs, policy_cost, score_table, totals


def _curve(scored: DataFrame, label: str) -> DataFrame:
    """Each distinct score with its own counts, the counts at or above it, and the totals."""
    table = score_table(scored, label)
    a = at_or_above(table, table.select(F.col("p").alias("t")))
    return table.select("p", "pos", "neg").join(a.select(F.col("t").alias("p"), "a_pos", "a_neg"), "p").crossJoin(F.broadcast(totals(table).select("t_pos", "t_neg")))


def pr_auc(scored: DataFrame, label: str = "is_abuse") -> DataFrame:
    """Average precision: over distinct scores, precision weighted by the gain in recall."""
    step = F.col("pos") / F.col("t_pos") * F.col("a_pos") / (F.col("a_pos") + F.col("a_neg"))
    return _curve(scored, label).agg(F.sum(step).alias("pr_auc"))


def roc_auc(scored: DataFrame, label: str = "is_abuse") -> DataFrame:
    """Share of positive-negative pairs in the right order; ties count half."""
    above = F.col("a_neg") - F.col("neg")
    right = F.col("pos") * (F.col("t_neg") - above - F.col("neg") + F.col("neg") / 2)
    return _curve(scored, label).agg((F.sum(right) / F.max(F.col("t_pos") * F.col("t_neg"))).alias("roc_auc"))


def brier(scored: DataFrame, label: str = "is_abuse") -> DataFrame:
    return scored.agg(F.avg((F.col("p") - F.col(label)) ** 2).alias("brier"))


def precision_at_recall(scored: DataFrame, levels: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9), label: str = "is_abuse") -> DataFrame:
    """For each recall level the highest threshold that still reaches it, and the precision there."""
    c = _curve(scored, label).select("p", (F.col("a_pos") / F.col("t_pos")).alias("recall"), (F.col("a_pos") / (F.col("a_pos") + F.col("a_neg"))).alias("precision"))
    c = c.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).where(F.col("recall") >= F.col("level"))
    return c.groupBy("level").agg(F.max("p").alias("threshold"), F.max_by("precision", "p").alias("precision"))


def reliability_bins(scored: DataFrame, n_bins: int = 12, label: str = "is_abuse") -> DataFrame:
    """bin, n, mean_pred, observed on distinct quantile edges (equal widths if they are fewer than three)."""
    q = exact_quantiles(scored, "p", np.linspace(0, 1, n_bins + 1).tolist(), width=SCORE_WIDTH).select(F.array_distinct("q").alias("q"))
    even = F.array(*[F.lit(float(x)) for x in np.linspace(0, 1, n_bins + 1)])
    q = q.select(F.when(F.size("q") < 3, even).otherwise(F.col("q")).alias("q"))
    b = scored.crossJoin(F.broadcast(q))  # one row
    inner = F.slice("q", F.lit(2), F.size("q") - 2)
    b = b.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("p"))))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg(label).alias("observed"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("observed"))) / F.sum("n")).alias("ece"))


def _shares(p, lo: float, hi: float) -> dict:
    b = band(p, lo, hi)
    return {k: F.avg(F.when(b == v, 1.0).otherwise(0.0)) for k, v in (("action_share", "auto_action"), ("review_share", "review"), ("missed_share", "pass"))}


def _with_median(out: DataFrame, scored: DataFrame, by: str) -> DataFrame:
    """``out`` (a row a segment) with the segment's median score."""
    medians = exact_quantiles(scored, "p", [0.5], [by], SCORE_WIDTH).select(F.col(by).alias("_segment"), F.get("q", F.lit(0)).alias("median_score"))
    return out.join(medians, F.col(by).eqNullSafe(F.col("_segment")), "left").drop("_segment")


def recall_by_ring_type(scored: DataFrame, lo: float, hi: float, label: str = "is_abuse") -> DataFrame:
    s, own = _shares("p", lo, hi), scored.where(F.col(label) == 1)
    out = own.groupBy("ring_type").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in s.items()], (s["action_share"] + s["review_share"]).alias("recall_with_review"))
    return _with_median(out, own, "ring_type")


def fp_by_population(scored: DataFrame, lo: float, hi: float, label: str = "is_abuse") -> DataFrame:
    s, own = _shares("p", lo, hi), scored.where(F.col(label) == 0).withColumn("population", F.coalesce("hn_type", F.lit("none")))
    out = own.groupBy("population").agg(F.count("*").alias("n"), s["action_share"].alias("fp_rate"), s["review_share"].alias("review_rate"), F.sum((F.col("p") >= hi).cast("int")).alias("n_fp"))
    return _with_median(out, own, "population")


def evaluation_summary(scored: DataFrame, lo: float, hi: float, label: str = "is_abuse") -> DataFrame:
    """One row with everything; run again with another label for the ceiling against true labels."""
    act = F.col("p") >= hi
    y = F.col(label) == 1
    base = scored.agg(
        F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("base_rate"), (F.sum(F.when(act & y, 1).otherwise(0)) / F.greatest(F.sum(act.cast("int")), F.lit(1))).alias("precision"),
        (F.sum(F.when(act & y, 1).otherwise(0)) / F.greatest(F.sum(label), F.lit(1))).alias("recall"),
    )
    cost = policy_cost(scored, lo, hi, label=label).select("cost_per_1000", "review_share")
    single = policy_cost(scored, hi, hi, label=label).select(F.col("cost_per_1000").alias("single_cost_per_1000"))
    out = base
    for part in (pr_auc(scored, label), roc_auc(scored, label), brier(scored, label), expected_calibration_error(reliability_bins(scored, label=label)), cost, single, baseline_costs(scored, label=label).select("do_nothing_per_1000", "block_all_per_1000")):
        out = out.crossJoin(part)  # one row each
    return out.withColumn("saving_per_1000", F.col("do_nothing_per_1000") - F.col("cost_per_1000"))


def compare_runs(one: DataFrame, other: DataFrame) -> DataFrame:
    """metric, first, second, delta of two one-row tables of the same columns."""
    long = lambda d, n: d.unpivot([], d.columns, "metric", n)
    cast = lambda d: d.select(*[F.col(c).cast("double").alias(c) for c in d.columns])
    return long(cast(one), "first").join(long(cast(other), "second"), "metric").withColumn("delta", F.col("second") - F.col("first"))
