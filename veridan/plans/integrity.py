"""Verification of a frozen table by a tree of digests: a change is named by id without comparing all rows.

A row's digest is the SHA-256 of its columns, each with its length, so no two rows read alike. A node holds the rows of a
range of ids, 16 times as wide on each level: their number and the sums of four slices of their digests. Sums don't depend on
order or partitioning, count repeated rows, and a level is the sum of the level below, so no buffer grows with a node. Two
trees are compared from the top; a level is only looked at below nodes that differ, and an unchanged table costs its top level.

Defined cases: a null id is a node of its own on each level. Rows that repeat an id are one leaf. Two empty tables are equal.
Tables are compared over the same columns; another column or type is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import scratch, stored

FAN, LEVELS = 16, 5
_SLICES = range(4)


def row_digest(columns: list[str]) -> Column:
    """Hex SHA-256 of a row: ``-`` for null, else length, colon and value of each column."""
    text = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


class DigestTree:
    """The levels of a table's tree, written below one path; ``level`` 0 has a node for each id."""

    def __init__(self, rows: DataFrame, key: str, levels: int = LEVELS):
        spark, self.levels, self.schema = rows.sparkSession, levels, sorted(rows.dtypes)
        self.path = scratch(spark, "digest-tree")
        d = rows.select(F.col(key).cast("long").alias("node"), row_digest([c for c, _ in self.schema]).alias("h"))
        parts = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"d{i}") for i in _SLICES]
        level = d.select("node", F.lit(1).cast("long").alias("n"), *parts)
        for i in range(levels):
            level = level.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(f"d{j}").cast("decimal(38,0)").alias(f"d{j}") for j in _SLICES])
            level.write.parquet(f"{self.path}/level={i}")
            level = self.level(spark, i).withColumn("node", F.floor(F.col("node") / FAN))

    def level(self, spark, i: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/level={i}")


def changed_ids(before: DigestTree, now: DigestTree, spark) -> DataFrame:
    """(id, change): ``changed``, ``missing`` or ``added`` for each id whose rows differ."""
    if before.schema != now.schema or before.levels != now.levels:
        raise ValueError(f"trees of different tables: {before.schema} and {now.schema}")
    differ = None
    for i in reversed(range(before.levels)):
        a, b = before.level(spark, i), now.level(spark, i)
        if differ is not None:
            above = differ.select(F.col("node").alias("_up"))
            a, b = (x.join(above, F.floor(F.col("node") / FAN).eqNullSafe(F.col("_up")), "left_semi") for x in (a, b))
        b = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])
        both = a.join(b, F.col("node").eqNullSafe(F.col("_node")) & F.col("n").isNotNull() & F.col("_n").isNotNull(), "full_outer")
        same = F.lit(True)
        for c in ("n", *[f"d{j}" for j in _SLICES]):
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        change = F.when(F.col("n").isNull(), "added").when(F.col("_n").isNull(), "missing").otherwise("changed")
        differ = stored(both.where(~same).select(F.when(F.col("n").isNull(), F.col("_node")).otherwise(F.col("node")).alias("node"), change.alias("change")), "differing")
        if differ.isEmpty():
            break
    return differ.withColumnRenamed("node", "id")
