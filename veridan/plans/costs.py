"""Money cost of a three-band policy, threshold and band sweeps, selection and its sensitivity.

A policy's cost is linear in counts and sums of value on either side of its edges, so one table of sums by
score answers every sweep and every cost world; no grid meets the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import exact_quantiles, running_two_level
from ..operators.tables import stored


@dataclass(frozen=True)
class Cost:
    """The economics of a cash-on-delivery order, in rupees."""

    forward: float = 75.0
    reverse: float = 85.0
    handling: float = 40.0
    loss: float = 0.72
    margin: float = 0.18
    abandon: float = 0.34
    churn: float = 0.22
    residual: float = 1450.0
    review: float = 32.0
    accuracy: float = 0.88
    capacity: float = 0.05

    @property
    def fn_fixed(self) -> float:
        return self.forward + self.reverse + self.handling

    @property
    def fp_rate(self) -> float:
        return self.abandon * self.margin

    @property
    def fp_fixed(self) -> float:
        return self.churn * self.residual


COST = Cost()
LO_RANGE, HI_RANGE = (0.004, 0.60), (0.30, 0.95)
#: Buckets of scores in which ranks and running sums are counted.
SCORE_WIDTH = 0.001
SUMS = ["pos", "neg", "v_pos", "v_neg"]


def order_costs(orders: DataFrame, cost: Cost = COST) -> DataFrame:
    """What a miss, a false alarm and a review of each order cost."""
    v = F.col("value_inr")
    return orders.select("order_id", (cost.fn_fixed + cost.loss * v).alias("miss_cost"), (cost.fp_rate * v + cost.fp_fixed).alias("alarm_cost"), F.lit(cost.review).alias("review_cost"))


def score_table(scored: DataFrame, label: str = "is_abuse") -> DataFrame:
    """A row for each distinct score: positives, negatives and their value."""
    y, v = F.col(label), F.col("value_inr")
    return scored.groupBy("p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.sum(v * y).alias("v_pos"), F.sum(v * (1 - y)).alias("v_neg"))


def at_or_above(table: DataFrame, thresholds: DataFrame, width: float = SCORE_WIDTH) -> DataFrame:
    """t and the sums over scores >= t. Two levels (buckets of scores, then within one), so that any number of
    distinct scores will do."""
    rows = table.select((-F.col("p")).alias("ts_sec"), F.lit(0).alias("kind"), F.lit(0).alias("order_id"), *SUMS)
    cuts = thresholds.select((-F.col("t")).alias("ts_sec"), F.lit(1).alias("kind"), F.lit(0).alias("order_id"), *[F.lit(0).alias(c) for c in SUMS])
    both = running_two_level(rows.unionByName(cuts), [], {f"a_{c}": F.col(c) for c in SUMS}, bucket=width)
    return both.select((-F.col("ts_sec")).alias("t"), *[f"a_{c}" for c in SUMS])


def totals(table: DataFrame) -> DataFrame:
    return table.agg(*[F.sum(c).alias(f"t_{c}") for c in SUMS])  # one row


def _cost_columns(c: dict[str, Column]) -> dict[str, Column]:
    """Policy figures from sums at or above lo (l_*), at or above hi (h_*) and totals (t_*)."""
    s = {k: F.col(k) for x in SUMS for k in (f"l_{x}", f"h_{x}", f"t_{x}")}
    miss = lambda n, v: c["fn_fixed"] * n + c["loss"] * v
    alarm = lambda n, v: c["fp_fixed"] * n + c["fp_rate"] * v
    n = s["t_pos"] + s["t_neg"]
    rev = {x: s[f"l_{x}"] - s[f"h_{x}"] for x in SUMS}
    total = (
        miss(s["t_pos"] - s["l_pos"], s["t_v_pos"] - s["l_v_pos"]) + alarm(s["h_neg"], s["h_v_neg"]) + c["review"] * (rev["pos"] + rev["neg"])
        + (1 - c["accuracy"]) * (miss(rev["pos"], rev["v_pos"]) + alarm(rev["neg"], rev["v_neg"]))
    )
    return {
        "total_cost": total, "cost_per_1000": total / n * 1000, "pass_share": (n - s["l_pos"] - s["l_neg"]) / n, "review_share": (rev["pos"] + rev["neg"]) / n,
        "action_share": (s["h_pos"] + s["h_neg"]) / n, "n_review": rev["pos"] + rev["neg"], "tp": s["h_pos"], "fp": s["h_neg"], "fn": s["t_pos"] - s["l_pos"],
        "tn": s["t_neg"] - s["l_neg"], "caught_in_review": rev["pos"],
    }


def _literals(cost: Cost) -> dict[str, Column]:
    return {k: F.lit(getattr(cost, k)) for k in ("fn_fixed", "loss", "fp_fixed", "fp_rate", "review", "accuracy")}


def priced(bands: DataFrame, table: DataFrame, cost: Cost | None = COST) -> DataFrame:
    """Figures of each band (lo, hi) of a small table; with ``cost`` None the rows bring their own prices."""
    edges = bands.select(F.col("lo").alias("t")).union(bands.select("hi")).distinct()
    a = at_or_above(table, edges)
    low = a.select(F.col("t").alias("lo"), *[F.col(f"a_{x}").alias(f"l_{x}") for x in SUMS])
    high = a.select(F.col("t").alias("hi"), *[F.col(f"a_{x}").alias(f"h_{x}") for x in SUMS])
    out = bands.join(F.broadcast(low), "lo").join(F.broadcast(high), "hi").crossJoin(F.broadcast(totals(table)))  # a few hundred edges; one row
    prices = _literals(cost) if cost else {k: F.col(k) for k in ("fn_fixed", "loss", "fp_fixed", "fp_rate", "review", "accuracy")}
    figures = _cost_columns(prices)
    return out.select(*bands.columns, *[c.alias(n) for n, c in figures.items()])


def policy_cost(scored: DataFrame, lo: float, hi: float, cost: Cost = COST, label: str = "is_abuse") -> DataFrame:
    """One row: cost and shares of pass (p < lo), review (lo <= p < hi) and action (p >= hi)."""
    p, y, v = F.col("p"), F.col(label) == 1, F.col("value_inr")
    low, rev, act = p < lo, (p >= lo) & (p < hi), p >= hi
    miss, alarm = cost.fn_fixed + cost.loss * v, cost.fp_fixed + cost.fp_rate * v
    wrong = F.when(y, miss).otherwise(alarm)
    each = F.when(low & y, miss).when(act & ~y, alarm).when(rev, cost.review + (1 - cost.accuracy) * wrong).otherwise(0.0)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return scored.agg(
        F.sum(each).alias("total_cost"), (F.avg(each) * 1000).alias("cost_per_1000"), share(low).alias("pass_share"), share(rev).alias("review_share"),
        share(act).alias("action_share"), count(rev).alias("n_review"), count(act & y).alias("tp"), count(act & ~y).alias("fp"), count(low & y).alias("fn"),
        count(low & ~y).alias("tn"), count(rev & y).alias("caught_in_review"),
    )


def baseline_costs(scored: DataFrame, cost: Cost = COST, label: str = "is_abuse") -> DataFrame:
    """Without a detector every abuse lands; with COD switched off every genuine order is blocked."""
    y, v = F.col(label) == 1, F.col("value_inr")
    nothing = F.when(y, cost.fn_fixed + cost.loss * v).otherwise(0.0)
    block = F.when(~y, cost.fp_fixed + cost.fp_rate * v).otherwise(0.0)
    return scored.agg(
        F.sum(nothing).alias("do_nothing_total"), (F.avg(nothing) * 1000).alias("do_nothing_per_1000"), F.sum(block).alias("block_all_total"), (F.avg(block) * 1000).alias("block_all_per_1000")
    )


def thresholds(scored: DataFrame, points: int = 400) -> DataFrame:
    """Distinct quantiles of the scores, and 0 and 1."""
    q = exact_quantiles(scored, "p", np.linspace(0, 1, points).tolist(), width=SCORE_WIDTH)
    q = q.select(F.explode(F.array_distinct("q")).alias("t"))
    q = q.select(F.least(F.greatest("t", F.lit(0.0)), F.lit(1.0)).alias("t")).union(q.sparkSession.createDataFrame([(0.0,), (1.0,)], "t double"))
    return stored(q, "thresholds")  # ``points`` rows and two: made once, read wherever they are needed


def cost_curve(scored: DataFrame, points: int = 400, cost: Cost = COST, table: DataFrame | None = None) -> DataFrame:
    """Cost of acting at each threshold, without a review band."""
    t = thresholds(scored, points)
    return priced(t.select(F.col("t").alias("lo"), F.col("t").alias("hi")).distinct(), score_table(scored) if table is None else table, cost).withColumnRenamed("lo", "threshold").drop("hi")


def band_grid(spark: SparkSession, n: int = 60) -> DataFrame:
    rows = [(float(lo), float(hi)) for lo in np.linspace(*LO_RANGE, n) for hi in np.linspace(*HI_RANGE, n) if hi > lo]
    return spark.createDataFrame(rows, "lo double, hi double")


def band_sweep(scored: DataFrame, n: int = 60, cost: Cost = COST, table: DataFrame | None = None) -> DataFrame:
    return priced(band_grid(scored.sparkSession, n), score_table(scored) if table is None else table, cost)


def select_policy(scored: DataFrame, cost: Cost = COST, points: int = 400, n: int = 60) -> DataFrame:
    """One row: cheapest band within review capacity (ties: least lo, then hi), best threshold, baselines, saving.

    ValueError if no band keeps within the capacity.
    """
    table = stored(score_table(scored), "scores")
    bands = band_sweep(scored, n, cost, table).where(F.col("review_share") <= cost.capacity)
    best = bands.agg(F.min(F.struct("cost_per_1000", "lo", "hi", "review_share", "action_share")).alias("b")).where("b IS NOT NULL").select("b.*").select(
        F.col("lo").alias("band_lo"), F.col("hi").alias("band_hi"), F.col("cost_per_1000").alias("band_cost_per_1000"), F.col("review_share").alias("band_review_share"),
        F.col("action_share").alias("band_action_share"),
    )
    best = stored(best, "policy")  # one row: the sweep runs once for the test and the result
    if best.isEmpty():
        raise ValueError("no band keeps within the review capacity")
    single = cost_curve(scored, points, cost, table).agg(F.min(F.struct("cost_per_1000", "threshold")).alias("s"))
    single = single.select(F.col("s.threshold").alias("single_threshold"), F.col("s.cost_per_1000").alias("single_cost_per_1000"))
    base = baseline_costs(scored, cost).select("do_nothing_per_1000", "block_all_per_1000")
    out = best.crossJoin(single).crossJoin(base)  # one row each
    saving = F.col("do_nothing_per_1000") - F.col("band_cost_per_1000")
    return out.withColumn("saving_per_1000", saving).withColumn("saving_pct", 100 * saving / F.col("do_nothing_per_1000"))


def worlds(cost: Cost = COST) -> list[tuple[str, str, Cost]]:
    """The 28 cost worlds: as is, four economic knobs, reviewer accuracy, review capacity."""
    out = [("none", "baseline", cost)]
    knobs = {
        "fn_fixed": lambda k: replace(cost, forward=cost.forward * (1 + k), reverse=cost.reverse * (1 + k), handling=cost.handling * (1 + k)),
        "fn_variable": lambda k: replace(cost, loss=min(cost.loss * (1 + k), 1.0)),
        "fp_fixed": lambda k: replace(cost, residual=cost.residual * (1 + k)),
        "fp_variable": lambda k: replace(cost, margin=cost.margin * (1 + k)),
    }
    out += [(name, f"{int(k * 100):+d}%", f(k)) for name, f in knobs.items() for k in (-0.5, -0.25, 0.25, 0.5)]
    out += [("review_precision", f"{a * 100:.0f}%", replace(cost, accuracy=a)) for a in (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)]
    return out + [("max_review_share", f"{a * 100:.0f}%", replace(cost, capacity=a)) for a in (0.02, 0.03, 0.05, 0.07, 0.1)]


_PRICES = ["fn_fixed", "loss", "fp_fixed", "fp_rate", "review", "accuracy", "capacity"]


def cost_sensitivity(scored: DataFrame, shipped_lo: float, shipped_hi: float, n: int = 40, points: int = 200) -> DataFrame:
    """A row for each cost world: the policy selected there, the shipped one priced there, and what it regrets."""
    spark, table = scored.sparkSession, stored(score_table(scored), "scores")
    w = spark.createDataFrame([(k, s, *[float(getattr(c, p)) for p in _PRICES]) for k, s, c in worlds()], "knob string, setting string, " + ", ".join(f"{p} double" for p in _PRICES))
    w = F.broadcast(w)
    world = ["knob", "setting"]
    grid = priced(band_grid(spark, n).crossJoin(w), table, None).where(F.col("review_share") <= F.col("capacity"))  # 28 worlds by the grid
    best = grid.groupBy(*world).agg(F.min(F.struct("cost_per_1000", "lo", "hi", "review_share", "action_share")).alias("b"))
    t = thresholds(scored, points).distinct()
    curve = priced(t.select(F.col("t").alias("lo"), F.col("t").alias("hi")).crossJoin(w), table, None)
    single = curve.groupBy(*world).agg(F.min(F.struct("cost_per_1000", "lo")).alias("s"))
    ship = spark.createDataFrame([(shipped_lo, shipped_hi)], "lo double, hi double").crossJoin(w)
    ship = priced(ship, table, None).select(*world, F.col("cost_per_1000").alias("cost_as_shipped"))
    zero = spark.createDataFrame([(2.0, 2.0)], "lo double, hi double").crossJoin(w)  # nothing is held back
    zero = priced(zero, table, None).select(*world, F.col("cost_per_1000").alias("cost_do_nothing"))
    every = spark.createDataFrame([(-1.0, -1.0)], "lo double, hi double").crossJoin(w)  # everything is
    every = priced(every, table, None).select(*world, F.col("cost_per_1000").alias("cost_block_all"))
    out = best.join(single, world).join(ship, world).join(zero, world).join(every, world)
    c, s = F.col("b.cost_per_1000"), F.col("s.cost_per_1000")
    return out.select(
        *world, F.col("s.lo").alias("single_threshold"), F.col("b.lo").alias("band_lo"), F.col("b.hi").alias("band_hi"), F.col("b.review_share").alias("review_share"),
        c.alias("cost_reselected"), "cost_as_shipped", s.alias("cost_single"), "cost_do_nothing", "cost_block_all", (c < s).alias("beats_single"),
        (c < F.col("cost_do_nothing")).alias("beats_nothing"), (F.col("cost_as_shipped") < s).alias("shipped_beats_single"),
        (F.col("cost_as_shipped") < F.col("cost_do_nothing")).alias("shipped_beats_nothing"), (F.col("cost_as_shipped") - c).alias("regret"),
        ((F.col("b.lo") < F.col("b.hi")) & (F.col("b.review_share") > 0.0005)).alias("band_survives"),
    )


def sensitivity_verdict(sensitivity: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", "knob", "setting")
    return sensitivity.agg(
        F.count("*").alias("n_worlds"), F.bool_and("beats_single").alias("all_beat_single"), F.bool_and("beats_nothing").alias("all_beat_nothing"),
        F.bool_and("shipped_beats_single").alias("all_shipped_beat_single"), F.bool_and("shipped_beats_nothing").alias("all_shipped_beat_nothing"), F.bool_and("band_survives").alias("all_bands_survive"), F.min("band_lo").alias("band_lo_min"),
        F.max("band_lo").alias("band_lo_max"), F.min("band_hi").alias("band_hi_min"), F.max("band_hi").alias("band_hi_max"), F.max("regret").alias("max_regret"),
        F.min("single_threshold").alias("single_threshold_min"), F.max("single_threshold").alias("single_threshold_max"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("band_survives"), name))), ",").alias("band_collapses"), F.max_by(name, "regret").alias("max_regret_world"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("beats_single"), name))), ",").alias("loses_to_single"),
    )
