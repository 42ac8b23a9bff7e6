"""Chat formatting by perspective rotation: every participant once as the assistant.

For each conversation and each speaker in it, the whole dialogue is rendered with that speaker's turns as the
assistant's and all other speakers' as named users; system turns stay system turns. The mask holds the
character spans that are trained on: the assistant's texts with their end marks.

A rendering is cut into parts of ``TURNS`` turn numbers, so a conversation of any length is bounded rows. Where
more than ``MOST`` different turns claim the numbers of one part, each number is a part of its own, cut after every
``MOST`` turns in their order. Parts follow each other in the order (part_turn, part_sub), so read one after
another they are the dialogue, whatever its size.

Marks can't be forged: ``<|`` in a text is written ``<||``, and in a role ``& < > |`` and line breaks are written as
character references (&amp; &lt; &gt; &#124; &#10;).

Defined cases: equal rows (conversation, turn, role, text) are one turn; turns of one number are ordered by
role, then text. A null text is empty, a null role is the speaker ``unknown``, a null turn counts as -1; rows
without conv_id belong to no conversation and are left out. A conversation of system turns only has no
perspective. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Turn numbers in a part, and turns that a part holds before it is cut further.
TURNS, MOST = 256, 4096


def rotate(conversations: DataFrame, turns: int = TURNS, most: int = MOST) -> DataFrame:
    """conv_id, perspective, part_turn, part_sub, n_turns, text, mask (array of start and end, in characters)."""
    t = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.distinct().withColumn("bucket", F.expr(f"turn - pmod(turn, {turns})"))
    # Few or no rows: written, so that the joins below know how small they are.
    over = t.groupBy("conv_id", "bucket").count().where(F.col("count") > most).select("conv_id", "bucket", F.lit(True).alias("full"))
    over = stored(over, "chat-full")
    t = t.join(over, ["conv_id", "bucket"], "left")
    fits = t.where("full IS NULL").select("conv_id", F.col("bucket").alias("part_turn"), F.lit(0).alias("part_sub"), "turn", "role", "text")
    t = fits.unionByName(_ranked(t.where("full"), most)) if not over.isEmpty() else fits

    speakers = t.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    parts = t.groupBy("conv_id", "part_turn", "part_sub").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = parts.join(speakers, "conv_id")
    shown = F.expr(
        "transform(turns, t -> named_struct('mine', t.role = perspective, 'text', concat(case when t.role = perspective then '<|assistant|>\\n'"
        f" when t.role = 'system' then '<|system|>\\n' else concat('<|user name=', {_ROLE.format('t.role')}, '|>\\n') end, {_TEXT.format('t.text')}, '<|end|>\\n'), 'head',"
        " case when t.role = perspective then length('<|assistant|>\\n') else 0 end))"
    )
    rows = rows.withColumn("shown", shown)
    mask = F.expr(
        "aggregate(shown, named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, end: bigint>>)), (a, x) -> named_struct("
        "'at', a.at + length(x.text), 'spans', if(x.mine, concat(a.spans, array(named_struct('start', a.at + x.head, 'end', a.at + length(x.text) - 1))),"
        " a.spans)), a -> a.spans)"
    )
    return rows.select(
        "conv_id", "perspective", "part_turn", "part_sub", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("shown", lambda x: x["text"]), "").alias("text"), mask.alias("mask"),
    )


def _ranked(t: DataFrame, most: int) -> DataFrame:
    """Turns of overfull parts with their place by rank: ``most`` turns a part in the order (role, text).

    Ranks come from a range shuffle over the whole order: the place within a range, and counts of the ranges before.
    """
    spark = t.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    ranged = t.select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "chat-ranged")
    before = ranged.groupBy("conv_id", "turn", "range").count()  # a row for each range that a turn number reaches into
    before = before.select("conv_id", "turn", "range", F.expr("coalesce(sum(count) over (partition by conv_id, turn order by range rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    inside = ranged.withColumn("inside", F.expr("row_number() over (partition by conv_id, turn, range order by role, text) - 1"))
    rank = inside.join(before, ["conv_id", "turn", "range"])
    return rank.select("conv_id", F.col("turn").alias("part_turn"), F.expr(f"int((before + inside) div {most})").alias("part_sub"), "turn", "role", "text")


#: Text and role as they stand in a rendering, in Spark and in DuckDB.
_TEXT = "replace({}, '<|', '<||')"
_ROLE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '&#124;'), chr(10), '&#10;')"

ROTATION_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(CAST(turn AS BIGINT), -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT *, turn - ((turn % {TURNS}) + {TURNS}) % {TURNS} AS bucket FROM t),
k AS (SELECT *, count(*) OVER (PARTITION BY conv_id, bucket) AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1 AS rank FROM c),
b AS (SELECT conv_id, turn, role, text, CASE WHEN n > {MOST} THEN turn ELSE bucket END AS part_turn, CAST(CASE WHEN n > {MOST} THEN rank // {MOST} ELSE 0 END AS INTEGER) AS part_sub FROM k),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT b.*, perspective, role = perspective AS mine,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || {_ROLE.format('role')} || '|>' END
      || chr(10) || {_TEXT.format('text')} || '<|end|>' || chr(10) AS shown
  FROM b JOIN s USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY conv_id, perspective, part_turn, part_sub ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT conv_id, perspective, part_turn, part_sub, count(*) AS n_turns,
  string_agg(shown, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(CAST(CAST(pos AS BIGINT) + 14 AS VARCHAR) || '-' || CAST(CAST(pos AS BIGINT) + length(shown) - 1 AS VARCHAR), ','
    ORDER BY turn, role, text) FILTER (WHERE mine), '') AS mask
FROM o GROUP BY conv_id, perspective, part_turn, part_sub
"""
