"""Ranks and running sums over any key by ranges of rows: no key, however hot, passes one task.

The rows are put in order of (key, order) by ranges of about equal size and written down with the number of their range
and their place in it. A key lies in one range or in neighbouring ones, so what a row needs from before its own range is
a sum over a few segments (key, range). There are at most as many segments as keys and ranges together, and a key has
at most one in each range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored, stored_by

_PLACE_BITS = 33  # monotonically_increasing_id: the partition above, the place in it below


def in_ranges(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` as a table in ranges of ``order``, with ``_part`` (range, in order) and ``_at`` (place in it, from 0).

    Ranges come from a sample, so only the written table tells where a row lies: all later steps read it.
    """
    df = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    low = (1 << _PLACE_BITS) - 1
    return stored_by(df.withColumns({"_part": F.shiftright("_id", _PLACE_BITS), "_at": F.col("_id").bitwiseAND(F.lit(low))}).drop("_id"), name, "_part")


def null_safe(key: list[str], prefix: str) -> Column:
    """Each key equals the column of that name after ``prefix``; nulls equal nulls."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in key], F.lit(True))


def ranked(df: DataFrame, key: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``_rank``, the place (from 0) among the rows of its key in ``order``, and ``_total``, their number.

    Nulls of a key are a key and come first. Rows that tie in ``order`` get places in no defined order among them.
    """
    rows = in_ranges(df, [*[F.col(k).asc_nulls_first() for k in key], *order], name)
    seg = rows.groupBy(*key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*(key or [F.lit(0)]))
    seg = seg.select(
        *[F.col(k).alias(f"_k_{k}") for k in key], F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"),
    )
    out = rows.join(seg, null_safe(key, "_k_") & (F.col("_part") == F.col("_p")))
    return out.withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_p", "_first", "_before", "_part", "_at", *[f"_k_{k}" for k in key])


#: Steepest exponent of a weight, and how many tau of history are looked at: what is older adds less than exp(-60) a row.
_STEEP, _REACH = 300, 60
TIME = "ts_sec"


@dataclass
class Prefix:
    """What :func:`prefix` gives of the rows before: names to columns.

    ``fades``: name to (weight, seconds of its event, tau): the sum of weight * exp(-(now - seconds) / tau).
    ``moments``: names (n, mean, m2) to a column: count, mean and sum of squared distances from it. Nulls don't count.
    """

    sums: dict[str, Column | str] = field(default_factory=dict)
    least: dict[str, Column | str] = field(default_factory=dict)
    most: dict[str, Column | str] = field(default_factory=dict)
    fades: dict[str, tuple[Column | str, Column | str, float]] = field(default_factory=dict)
    moments: dict[tuple[str, str, str], Column | str] = field(default_factory=dict)


def _expr(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _merged(n0: Column, mean0: Column, m0: Column, n1: Column, mean1: Column, m1: Column) -> tuple[Column, Column, Column]:
    n = n0 + n1
    d = mean1 - mean0
    return n, F.when(n > 0, mean0 + d * n1 / n).otherwise(0.0), F.when(n > 0, m0 + m1 + d * d * n0 * n1 / n).otherwise(0.0)


def prefix(rows: DataFrame, key: list[str], order: list[str], what: Prefix, name: str, keep: str = "true") -> DataFrame:
    """The rows that ``keep`` names, each with aggregates over all rows of its key before it in ``order``.

    One scan serves all aggregates: the rows go by range of (key, order) into a table once, windows run in each range, and
    what lies before a range is added from its key's segments. Only keys that reach over a border of two ranges have such
    segments; their number is bounded by ranges and epochs, so they are broadcast. ``order`` must tell all rows of a key
    apart and begin with ``ts_sec``, whole seconds. An empty ``key`` is one key for all rows.

    Weights of fading sums are taken from the start of an epoch of 300 of the least tau, so they never overflow, and a
    sum has its own epoch and as many before it as reach 60 of the greatest tau.
    """
    values = {f"_v_{n}": _expr(c) for part in (what.sums, what.least, what.most) for n, c in part.items()}
    values |= {f"_v_{n[0]}": _expr(c).cast("double") for n, c in what.moments.items()}
    taus = [tau for _, _, tau in what.fades.values()]
    width = int(_STEEP * min(taus)) if taus else 0
    back = math.ceil(_REACH * max(taus) / width) if taus else 0
    rows = rows.withColumn("_e", F.floor(F.col(TIME) / width) if taus else F.lit(0).cast("long"))
    values |= {f"_v_{n}": _expr(w) * F.exp((_expr(t) - F.col("_e") * width) / tau) for n, (w, t, tau) in what.fades.items()}
    keyed = [F.col(k).asc_nulls_first() for k in key]
    t = in_ranges(rows.withColumns(values), [*keyed, *order], name)

    # Segments of keys that lie in several ranges.
    last = F.broadcast(t.groupBy("_part").agg(F.max("_at").alias("_last")).withColumnRenamed("_part", "_p"))  # a row a range
    ends = t.join(last, F.col("_part") == F.col("_p")).where((F.col("_at") == 0) | (F.col("_at") == F.col("_last")))
    ends = ends.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.countDistinct("_part").alias("_n")).where("_n > 1").drop("_n")
    ends = F.broadcast(ends)  # fewer keys than ranges
    at_border = t.join(ends, null_safe(key, "_k_"), "left_semi") if key else t
    add = [n for n in (*what.sums, *what.fades)]
    seg = at_border.groupBy(*key, "_part", "_e").agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in add], *[F.min(f"_v_{n}").alias(f"_s_{n}") for n in what.least], *[F.max(f"_v_{n}").alias(f"_s_{n}") for n in what.most],
        *[c for n, m, q in what.moments for c in (F.count(f"_v_{n}").alias(f"_s_{n}"), F.avg(f"_v_{n}").alias(f"_s_{m}"), (F.var_pop(f"_v_{n}") * F.count(f"_v_{n}")).alias(f"_s_{q}"))],
        F.lit(1).alias("_any"),
    )
    by = key or [F.lit(0)]
    earlier = Window.partitionBy(*by).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*by, "_e").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda i: Window.partitionBy(*by).orderBy("_e").rangeBetween(-i, -i)
    here = lambda i: Window.partitionBy(*by, "_part").orderBy("_e").rangeBetween(-i, -i)
    whole = Window.partitionBy(*by)
    off = {f"_o_{n}": F.sum(f"_s_{n}").over(earlier) for n in what.sums} | {f"_o_{n}": F.min(f"_s_{n}").over(earlier) for n in what.least}
    off |= {f"_o_{n}": F.max(f"_s_{n}").over(earlier) for n in what.most}
    for n in what.fades:
        off[f"_o_{n}"] = _zero(F.sum(f"_s_{n}").over(same))
        off |= {f"_o{i}_{n}": _zero(F.sum(f"_s_{n}").over(gone(i))) - _zero(F.sum(f"_s_{n}").over(here(i))) for i in range(1, back + 1)}
    for n, m, q in what.moments:
        # Distances from the key's own mean, so that squares don't outgrow what differs.
        mid = F.sum(F.col(f"_s_{n}") * _zero(F.col(f"_s_{m}"))).over(whole) / F.sum(f"_s_{n}").over(whole)
        d = _zero(F.col(f"_s_{m}") - mid)
        count, first = _zero(F.sum(f"_s_{n}").over(earlier)), F.sum(F.col(f"_s_{n}") * d).over(earlier)
        mean = F.when(count > 0, first / count).otherwise(0.0)
        off[f"_o_{n}"], off[f"_o_{m}"] = count, F.when(count > 0, mid + mean).otherwise(0.0)
        off[f"_o_{q}"] = _zero(F.sum(_zero(F.col(f"_s_{q}")) + F.col(f"_s_{n}") * d * d).over(earlier)) - count * mean * mean
    seg = seg.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_part").alias("_p"), F.col("_e").alias("_pe"), *[c.alias(n) for n, c in off.items()])

    # Each range by itself; all windows share one order.
    own = [*key, "_part"]
    before = Window.partitionBy(*own).orderBy("_e", *order).rowsBetween(Window.unboundedPreceding, -1)
    epoch = Window.partitionBy(*own, "_e").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    past = lambda i: Window.partitionBy(*own).orderBy("_e").rangeBetween(-i, -i)
    inside = {f"_i_{n}": F.sum(f"_v_{n}").over(before) for n in what.sums} | {f"_i_{n}": F.min(f"_v_{n}").over(before) for n in what.least}
    inside |= {f"_i_{n}": F.max(f"_v_{n}").over(before) for n in what.most}
    for n in what.fades:
        inside[f"_i_{n}"] = _zero(F.sum(f"_v_{n}").over(epoch))
        inside |= {f"_i{i}_{n}": _zero(F.sum(f"_v_{n}").over(past(i))) for i in range(1, back + 1)}
    for n, m, q in what.moments:
        c = F.col(f"_v_{n}")
        inside |= {f"_i_{n}": F.count(c).over(before), f"_i_{m}": _zero(F.avg(c).over(before)), f"_i_{q}": _zero(F.var_pop(c).over(before)) * F.count(c).over(before)}
    out = t.withColumns(inside).where(keep)
    out = out.join(F.broadcast(seg), null_safe(key, "_k_") & (F.col("_part") == F.col("_p")) & (F.col("_e") == F.col("_pe")), "left")
    i, o = (lambda n: F.col(f"_i_{n}")), (lambda n: F.col(f"_o_{n}"))
    got = {n: _zero(i(n)) + _zero(o(n)) for n in what.sums} | {n: F.least(i(n), o(n)) for n in what.least} | {n: F.greatest(i(n), o(n)) for n in what.most}
    for n, (_, _, tau) in what.fades.items():
        # Half the factor of an epoch twice: the whole might underflow before it meets a large sum.
        fade = lambda j, tau=tau: F.lit(math.exp(-j * width / tau / 2))
        total = sum(((F.col(f"_i{j}_{n}") + _zero(F.col(f"_o{j}_{n}"))) * fade(j) * fade(j) for j in range(1, back + 1)), _zero(i(n)) + _zero(o(n)))
        got[n] = total * F.exp(-(F.col(TIME) - F.col("_e") * width) / tau)
    for n, m, q in what.moments:
        got |= dict(zip((n, m, q), _merged(_zero(o(n)), _zero(o(m)), _zero(o(q)), i(n), i(m), i(q)), strict=True))
    return out.select(*[c for c in rows.columns if c not in got and c != "_e"], *[c.alias(n) for n, c in got.items()])
