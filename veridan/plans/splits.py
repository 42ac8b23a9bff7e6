"""Splits that keep groups whole, and fingerprints of what was held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seconds
from ..operators.asof import exact_quantiles, running_two_level


def group_split(rows: DataFrame, seed: int = 7, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """group_key, split: whole keys in the order of a seeded hash, cut by exact shares.

    Ranks come from counts of hash ranges and a window within a range: no single task orders all keys.
    """
    keys = rows.select("group_key").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), "group_key")))
    keys = keys.select("group_key", F.conv(F.substring("h", 1, 13), 16, 10).cast("long").alias("ts_sec"), F.lit(1).alias("kind"), F.col("group_key").alias("order_id"))
    ranked = running_two_level(keys, [], {"rank": F.lit(1)}, bucket=1 << 40)
    n = keys.agg(F.count("*").alias("n"))  # one row
    share = F.col("rank") / F.col("n")
    return ranked.crossJoin(F.broadcast(n)).select("group_key", F.when(share < train, "train").when(share < train + val, "val").otherwise("test").alias("split"))


def temporal_split(truth: DataFrame, boundary: Column) -> DataFrame:
    """order_id, split: train before the boundary, else test; test rows of rings seen earlier are dropped."""
    seen = F.min("order_ts").over(Window.partitionBy("ring_id")) < boundary
    rings = truth.where("ring_id >= 0").select("order_id", F.when(F.col("order_ts") < boundary, "train").when(seen, "drop").otherwise("test").alias("split"))
    rest = truth.where("ring_id < 0").select("order_id", F.when(F.col("order_ts") < boundary, "train").otherwise("test").alias("split"))
    return rings.union(rest)


def drop_crossing_groups(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """``later`` without the rows of rings that stand in ``earlier`` too."""
    rings = earlier.where("ring_id >= 0").select("ring_id").distinct()
    return later.join(rings, "ring_id", "left_anti")


def carve_validation(train: DataFrame, share: float = 0.2) -> DataFrame:
    """order_id, split: rows at or after the time quantile are val; groups active there give no train rows."""
    t = train.withColumn("ts_sec", seconds("order_ts"))
    cut = exact_quantiles(t, "ts_sec", [1 - share]).select(F.get("q", F.lit(0)).alias("cut"))  # one row
    t = t.crossJoin(F.broadcast(cut))
    active = t.where("ts_sec >= cut").select("group_key").distinct()
    val = t.where("ts_sec >= cut").select("order_id", F.lit("val").alias("split"))
    return val.union(t.join(active, "group_key", "left_anti").select("order_id", F.lit("train").alias("split")))


def fingerprint(rows: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """range, n, digest, rows_digest: SHA-256 of the sorted keys of each range of ids, and of their rows' own digests.

    A row's digest is that of its columns as text in the table's order, ``|`` between them, nulls as nothing. Equal for
    any partitioning.
    """
    own = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), 256)
    item = F.struct(F.col(key).cast("long").alias("id"), own.alias("row"))
    r = rows.groupBy(F.floor(F.col(key) / width).alias("range")).agg(F.array_sort(F.collect_list(item)).alias("ids"))
    joined = lambda f: F.sha2(F.array_join(F.transform("ids", f), ","), 256)
    return r.select("range", F.size("ids").cast("long").alias("n"), joined(lambda x: x["id"].cast("string")).alias("digest"), joined(lambda x: x["row"]).alias("rows_digest"))


def overall_fingerprint(ranges: DataFrame, levels: int = 4, fan: int = 1000) -> DataFrame:
    """One row: n, digest, rows_digest of all ranges; digests of ``fan`` neighbours, level by level, so no buffer grows."""
    for level in range(levels):
        at = F.floor(F.col("range") / fan) if level < levels - 1 else F.lit(0).cast("long")
        r = ranges.groupBy(at.alias("range")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("range", "digest", "rows_digest"))).alias("all"))
        joined = lambda f: F.sha2(F.array_join(F.transform("all", f), ","), 256)
        ranges = r.select("range", "n", joined(lambda x: x["digest"]).alias("digest"), joined(lambda x: x["rows_digest"]).alias("rows_digest"))
    return ranges.drop("range")


def verify_fingerprint(rows: DataFrame, key: str, expected: DataFrame, width: int = 1000) -> None:
    now = fingerprint(rows, key, width)
    if now.exceptAll(expected).limit(1).count() or expected.exceptAll(now).limit(1).count():
        raise ValueError("the held-out set has changed")
