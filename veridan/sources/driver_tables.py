"""Adapter: the TPC-H-like driver tables as orders, returns, customers, addresses, phones, truth and scores.

``world`` builds them as DataFrames. ``CTES`` are the same definitions in DuckDB SQL, the start of every oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # o_orderdate has no time zone: its seconds are taken as they stand, whatever the session's zone.
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz)) AS placed"
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_lines"),
        F.max("l_discount").alias("max_disc"),
        F.sum(F.expr("if(l_returnflag = 'R', 1, 0)")).alias("n_r"),
        F.min("l_partkey").alias("p_partkey"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    full = raw.join(lines, "o_orderkey", "left").join(part, "p_partkey", "left")
    orders = full.selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "if(o_orderkey % 11 = 0, o_custkey div 3, 1000000000000 + o_custkey) AS device_id",
        "o_custkey * 4 + o_orderkey % 4 AS address_id",
        "o_custkey AS phone_id",
        "timestamp_seconds(placed + (o_orderkey % 5) * 10800) AS order_ts",
        "if(o_orderpriority IN ('1-URGENT', '2-HIGH'), 'prepaid', 'COD') AS payment_mode",
        "coalesce(p_type, 'NONE') AS category",
        "o_totalprice AS value_inr",
        "cast(coalesce(n_lines, 0) AS int) AS item_count",
        "if(max_disc >= 0.08, 1, 0) AS promo_used",
    )
    returned = raw.select("o_orderkey", "placed").join(lines.where("n_r * 2 > n_lines"), "o_orderkey")
    returns = returned.selectExpr(
        "o_orderkey AS order_id", "timestamp_seconds(placed + (3 + o_orderkey % 23) * 86400) AS return_ts"
    )
    customers = raw.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.min("placed").alias("f"))
    customers = customers.selectExpr("customer_id", "timestamp_seconds(f - (customer_id % 90) * 86400) AS signup_ts")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    doors = c.selectExpr("c", "c - if(c % 3 = 1, 1, 0) AS d", "explode(sequence(0, 3)) AS k").selectExpr(
        "c * 4 + k AS address_id",
        "case k when 0 then concat('Flat ', 1 + d % 24, 'B, Sai Residency ', d div 6, ', MG Road')"
        " when 1 then concat('Flt ', 1 + d % 24, '-B, SAI RES. ', d div 6, '  MG Road')"
        " when 2 then concat('Apt ', 1 + d % 24, ' B , Sai Residency ', d div 6, ' - MG Road')"
        " else concat('No. ', 1 + d % 24, 'B, Sai Residency ', d div 6, ', MG Rd') end AS raw_line",
        "cast(110000 + (d div 6) % 50 AS int) AS pincode",
    )
    phones = c.selectExpr("c AS phone_id", "cast(7000000000 + (c div 4) * 137 + (c % 4) * 4 AS string) AS msisdn")
    t = orders.join(returns.select("order_id", F.lit(1).alias("back")), "order_id", "left")
    t = t.selectExpr(
        "order_id", "customer_id", "order_ts", "value_inr", "category", "payment_mode",
        "if(customer_id % 20 < 5, customer_id div 5, -1) AS ring_id",
        "if(customer_id % 7 = 0, customer_id div 3, -1) AS household_id",
        "if(customer_id % 20 < 5 AND payment_mode = 'COD' AND back = 1, 1, 0) AS is_abuse",
    )
    truth = t.selectExpr(
        "*",
        "if(ring_id >= 0, concat('R', 1 + ring_id % 5), 'none') AS ring_type",
        "if(household_id >= 0 AND customer_id % 2 = 0, 'shared_door', null) AS hn_type",
        "if(is_abuse = 1 OR (ring_id >= 0 AND payment_mode = 'COD' AND order_id % 40 = 0), 1, 0) AS is_abuse_true",
        "case when ring_id >= 0 then concat('ring_', ring_id) when household_id >= 0 then concat('hh_', household_id) else concat('cust_', customer_id) end AS group_key",
    )
    h = "(order_id * 7919 % 1000)"
    scored = truth.where("payment_mode = 'COD'").withColumn("p", F.expr(f"(350 * is_abuse + (650 * {h} * {h} * {h}) div 1000000000) / 1000D"))
    return {"orders": orders, "returns": returns, "customers": customers, "addresses": doors, "phones": phones, "truth": truth, "scored": scored}


CTES = """
WITH li AS (
  SELECT l_orderkey, count(*) AS n_lines, max(l_discount) AS max_disc, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
    min(l_partkey) AS min_part FROM lineitem GROUP BY l_orderkey),
ords AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE WHEN o_orderkey % 11 = 0 THEN o_custkey // 3 ELSE 1000000000000 + o_custkey END AS device_id,
    o_custkey * 4 + o_orderkey % 4 AS address_id, o_custkey AS phone_id,
    CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 5) * 10800 AS ts_sec,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'prepaid' ELSE 'COD' END AS payment_mode,
    coalesce(p_type, 'NONE') AS category, o_totalprice AS value_inr, CAST(coalesce(n_lines, 0) AS INTEGER) AS item_count,
    CASE WHEN max_disc >= 0.08 THEN 1 ELSE 0 END AS promo_used
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = min_part),
rets AS (
  SELECT o_orderkey AS order_id, CAST(epoch(o_orderdate) AS BIGINT) + (3 + o_orderkey % 23) * 86400 AS ret_sec
  FROM orders JOIN li ON l_orderkey = o_orderkey WHERE n_r * 2 > n_lines),
custs AS (SELECT o_custkey AS customer_id, CAST(epoch(min(o_orderdate)) AS BIGINT) - (o_custkey % 90) * 86400 AS signup_sec FROM orders GROUP BY o_custkey),
doors AS (
  SELECT c * 4 + k AS address_id,
    CASE k WHEN 0 THEN 'Flat ' || (1 + d % 24) || 'B, Sai Residency ' || (d // 6) || ', MG Road'
           WHEN 1 THEN 'Flt ' || (1 + d % 24) || '-B, SAI RES. ' || (d // 6) || '  MG Road'
           WHEN 2 THEN 'Apt ' || (1 + d % 24) || ' B , Sai Residency ' || (d // 6) || ' - MG Road'
           ELSE 'No. ' || (1 + d % 24) || 'B, Sai Residency ' || (d // 6) || ', MG Rd' END AS raw_line,
    CAST(110000 + (d // 6) % 50 AS INTEGER) AS pincode
  FROM (SELECT c_custkey AS c, c_custkey - CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END AS d FROM customer), (SELECT unnest([0, 1, 2, 3]) AS k)),
keyed AS (
  SELECT address_id, pincode, (1 + d % 24) || 'b' AS flat, d // 6 AS b, 'x' || pincode || '|' || (1 + d % 24) || '|' || (d // 6) AS cluster
  FROM (SELECT address_id, pincode, (address_id // 4) - CASE WHEN (address_id // 4) % 3 = 1 THEN 1 ELSE 0 END AS d FROM doors)),
fones AS (SELECT c_custkey AS phone_id, 7000000000 + (c_custkey // 4) * 137 + (c_custkey % 4) * 4 AS num FROM customer),
truth0 AS (
  SELECT o.order_id, o.customer_id, o.ts_sec, o.value_inr, o.category, o.payment_mode,
    CASE WHEN o.customer_id % 20 < 5 THEN o.customer_id // 5 ELSE -1 END AS ring_id,
    CASE WHEN o.customer_id % 7 = 0 THEN o.customer_id // 3 ELSE -1 END AS household_id,
    CASE WHEN o.customer_id % 20 < 5 AND o.payment_mode = 'COD' AND r.order_id IS NOT NULL THEN 1 ELSE 0 END AS is_abuse
  FROM ords o LEFT JOIN rets r ON r.order_id = o.order_id),
truth AS (
  SELECT *, CASE WHEN ring_id >= 0 THEN 'R' || (1 + ring_id % 5) ELSE 'none' END AS ring_type,
    CASE WHEN household_id >= 0 AND customer_id % 2 = 0 THEN 'shared_door' END AS hn_type,
    CASE WHEN is_abuse = 1 OR (ring_id >= 0 AND payment_mode = 'COD' AND order_id % 40 = 0) THEN 1 ELSE 0 END AS is_abuse_true,
    CASE WHEN ring_id >= 0 THEN 'ring_' || ring_id WHEN household_id >= 0 THEN 'hh_' || household_id ELSE 'cust_' || customer_id END AS group_key
  FROM truth0),
scored AS (
  SELECT *, ((350 * is_abuse + (650 * (order_id * 7919 % 1000) * (order_id * 7919 % 1000) * (order_id * 7919 % 1000)) // 1000000000) / 1000.0)::DOUBLE AS p
  FROM truth WHERE payment_mode = 'COD')
"""
