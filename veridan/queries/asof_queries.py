"""As-of features, joins and the identity graph over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import intrinsic, split_unit, with_address_cluster, with_address_parts
from ..operators import asof, features, graph
from ..sources.driver_tables import CTES, world

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _o(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    w = world(spark, sf_dir)
    return w, graph.stored(asof.resolved(w["orders"], features.clusters(w["addresses"])), "resolved")


def _plain(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Orders without their doors, for what doesn't ask for these."""
    w = world(spark, sf_dir)
    return w, graph.stored(asof.timed(w["orders"]), "orders")


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ``evs``: orders and returns as events, as in asof.event_stream; E and W: windows that end before the current row.
BASE = CTES + """,
o AS (SELECT ords.*, cluster, pincode, CASE WHEN payment_mode = 'COD' THEN 1 ELSE 0 END AS cod FROM ords LEFT JOIN keyed USING (address_id)),
evs AS (
  SELECT order_id, ts_sec, 1 AS kind, customer_id, device_id, phone_id, category, value_inr, cluster, pincode FROM o
  UNION ALL SELECT o.order_id, ret_sec, 0, customer_id, device_id, phone_id, category, value_inr, cluster, pincode FROM o JOIN rets ON rets.order_id = o.order_id)
"""


def _e(key: str) -> str:
    return f"(PARTITION BY {key} ORDER BY ts_sec, kind, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _w(key: str) -> str:
    return f"(PARTITION BY {key} ORDER BY ts_sec, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _rate_sql(key: str, name: str) -> str:
    return f"round((coalesce(sum(1 - kind) OVER {_e(key)}, 0) + 1)::DOUBLE / (coalesce(sum(kind) OVER {_e(key)}, 0) + 8), 5) AS {name}"


def order_intrinsic(spark, sf_dir):
    w = world(spark, sf_dir)
    return _rounded(w["orders"].select("order_id", "value_inr", "item_count", "promo_used", *[c.alias(n) for n, c in intrinsic(CATEGORIES).items()]))


def scoreable_orders(spark, sf_dir):
    return world(spark, sf_dir)["orders"].where("payment_mode = 'COD'").select("order_id", "customer_id", "value_inr")


def month_slice(spark, sf_dir, first: int = 3, last: int = 9):
    o = world(spark, sf_dir)["orders"]
    start = o.agg(F.date_trunc("month", F.min("order_ts")).alias("start"))  # one row
    o = o.crossJoin(F.broadcast(start))
    return o.where(F.col("order_ts") >= F.add_months("start", first)).where(F.col("order_ts") < F.add_months("start", last)).select("order_id", "value_inr")


def split_unit_key(spark, sf_dir):
    return world(spark, sf_dir)["truth"].select("order_id", split_unit().alias("group_key"))


def modelling_frame(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    f = asof.asof_customer(o).select("order_id", "cust_prior_orders", "cust_cod_share")
    t = w["truth"].select("order_id", "group_key", "is_abuse", F.col("value_inr").alias("value_inr_t"))
    frame = f.join(t, "order_id").join(w["orders"].select("order_id", "value_inr", "payment_mode"), "order_id").where("payment_mode = 'COD'")
    return _rounded(frame.withColumnRenamed("value_inr_t", "value_inr_o"))


def enrich_orders(spark, sf_dir):
    w = world(spark, sf_dir)
    c = w["customers"].select("customer_id", F.unix_seconds("signup_ts").alias("signup_sec"))
    return w["orders"].select("order_id", "customer_id").join(c, "customer_id", "left")


def asof_return_visibility(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    e = asof.event_stream(o, w["returns"])
    return asof.customer_part(e, o).select("order_id", F.col("cust_prior_returns").alias("visible_returns"))


def phone_neighbours(spark, sf_dir):
    return asof.phone_neighbours(world(spark, sf_dir)["phones"])


def address_lookup(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    return o.groupBy("pincode").agg(F.count("*").alias("n_orders"), F.countDistinct("cluster").alias("n_clusters"))


def normalise_address(spark, sf_dir):
    a = with_address_parts(world(spark, sf_dir)["addresses"], "raw_line", "flat", "words")
    return a.select("address_id", "flat", F.array_join("words", " ").alias("words"))


def address_clusters(spark, sf_dir):
    a = with_address_cluster(world(spark, sf_dir)["addresses"])
    return a.groupBy("cluster").agg(F.min("address_id").alias("first_address"), F.count("*").alias("n_addresses")).drop("cluster")


def asof_customer(spark, sf_dir):
    return _rounded(asof.asof_customer(_o(spark, sf_dir)[1]))


def asof_decayed_counts(spark, sf_dir):
    return _rounded(asof.asof_decayed_counts(_o(spark, sf_dir)[1]))


def asof_distinct(spark, sf_dir):
    return asof.asof_distinct(_o(spark, sf_dir)[1])


def asof_return_rates(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    return _rounded(asof.asof_return_rates(graph.stored(asof.event_stream(o, w["returns"]), "events")))


def asof_device(spark, sf_dir):
    return _rounded(asof.asof_entity(_plain(spark, sf_dir)[1], "device_id", "dev"))


def asof_address(spark, sf_dir):
    return _rounded(asof.asof_address(_o(spark, sf_dir)[1]))


def asof_pincode(spark, sf_dir):
    return asof.asof_pincode(_o(spark, sf_dir)[1])


def asof_phone_neighbours(spark, sf_dir):
    w, o = _plain(spark, sf_dir)
    return asof.asof_phone_neighbours(o, w["phones"])


def asof_category(spark, sf_dir):
    w, o = _plain(spark, sf_dir)
    return _rounded(asof.asof_category(asof.event_stream(o, w["returns"])))


def asof_global(spark, sf_dir):
    return asof.asof_global(_plain(spark, sf_dir)[1])


def asof_rates(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    e = graph.stored(asof.event_stream(o, w["returns"]), "events")
    f = asof.together([
        lambda: asof.tenure(o, w["customers"]), lambda: asof.customer_part(e, o), lambda: asof.device_part(e, o), lambda: asof.cluster_part(e, o), lambda: asof.pincode_part(e, o),
        lambda: asof.asof_global(o),
    ])
    return _rounded(asof.asof_rates(f).select("order_id", "cust_orders_per_day", "dev_orders_per_day", "addr_orders_per_day", "pin_orders_share", "pin_cust_share"))


def event_stream(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    e = asof.event_stream(o, w["returns"])
    return e.select("order_id", "ts_sec", "kind", "customer_id")


def union_order_sources(spark, sf_dir):
    """Two order sources as one, numbered from 0 in the order of time by day totals and a window within the day."""
    o = world(spark, sf_dir)["orders"].select("order_id", F.unix_seconds("order_ts").alias("ts_sec"), "payment_mode")
    both = o.where("payment_mode = 'COD'").unionByName(o.where("payment_mode <> 'COD'")).withColumn("kind", F.lit(1))
    return asof.running_two_level(both, [], {"number": F.lit(1)}).select("order_id", "number")


def _edges(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    return w, o, graph.identity_edges(o, w["phones"])


def identity_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[2]


def identity_components(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir)[2])


def comp_features_asof(spark, sf_dir):
    w, o, e = _edges(spark, sf_dir)
    e = graph.stored(e, "edges")
    return _rounded(graph.component_features(o, w["returns"], w["customers"], e))


def component_growth(spark, sf_dir):
    return comp_features_asof(spark, sf_dir).select("order_id", "comp_growth_d7")


def _inputs(w: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: w[k] for k in ("orders", "customers", "addresses", "phones", "returns")}


def build_features(spark, sf_dir):
    return _rounded(features.build_features(**_inputs(world(spark, sf_dir)), categories=CATEGORIES))


def prefix_truncate(spark, sf_dir):
    cut = features.prefix_truncate(world(spark, sf_dir), F.lit("1999-01-01").cast("timestamp"))
    parts = [df.select(F.lit(name).alias("input")) for name, df in cut.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4]).groupBy("input").agg(F.count("*").alias("n"))


def _cut(day: str):
    return F.lit(day).cast("timestamp")


def feature_diff(spark, sf_dir):
    """All features of the whole against those of the world before 1999."""
    diff = features.gate_table(_inputs(world(spark, sf_dir)), [_cut("1999-01-01")], tolerance=1e-9, categories=CATEGORIES)
    return diff.select("feature", "rows_differing", F.round("max_abs_delta", 5).alias("max_abs_delta"))


def causality_gate(spark, sf_dir):
    """Three cuts, of which the last one lies behind nearly all orders, in one build."""
    diff = features.causality_gate(_inputs(world(spark, sf_dir)), [_cut(d) for d in ("1996-07-01", "1998-01-01", "1999-01-01")], tolerance=1e-9, categories=CATEGORIES)
    return diff.withColumn("max_abs_delta", F.round("max_abs_delta", 5))


QUERIES = {f.__name__: f for f in (
    order_intrinsic, scoreable_orders, month_slice, split_unit_key, modelling_frame, enrich_orders, asof_return_visibility, phone_neighbours, address_lookup,
    normalise_address, address_clusters, asof_customer, asof_decayed_counts, asof_distinct, asof_return_rates, asof_device, asof_address, asof_pincode,
    asof_phone_neighbours, asof_category, asof_global, asof_rates, event_stream, union_order_sources, identity_edges, identity_components, comp_features_asof,
    component_growth, build_features, prefix_truncate, feature_diff, causality_gate,
)}

_DIST = lambda key, item, name: f"n_{name} AS (SELECT order_id, coalesce(sum(new) OVER {_w(key)}, 0) AS n, new FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {key}, {item} ORDER BY ts_sec, order_id) = 1 THEN 1 ELSE 0 END AS new FROM o))"

_TOK = "list_filter(string_split(regexp_replace(trim(regexp_replace(lower(raw_line), '[^a-z0-9]+', ' ', 'g')), '\\b(\\d+) ([a-z])\\b', '\\1\\2', 'g'), ' '), lambda w: w NOT IN ('flat','flt','apt','no','number','num','house','h','the','wing','block','blk','door','d',''))"
_EDGE = """,
n1 AS (SELECT a.phone_id, b.phone_id AS neighbour_id FROM fones a JOIN fones b ON abs(a.num - b.num) <= 5 AND a.phone_id <> b.phone_id AND a.num // 6 BETWEEN b.num // 6 - 1 AND b.num // 6 + 1),
use_d AS (SELECT device_id AS k, customer_id, min(ts_sec::HUGEINT * 10000000000 + order_id) AS t FROM o GROUP BY ALL),
use_c AS (SELECT cluster AS k, customer_id, min(ts_sec::HUGEINT * 10000000000 + order_id) AS t FROM o GROUP BY ALL),
use_p AS (SELECT phone_id AS k, customer_id, min(ts_sec::HUGEINT * 10000000000 + order_id) AS t FROM o GROUP BY ALL),
hub_p AS (SELECT k, arg_min(customer_id, t) AS hub, min(t) AS ht FROM use_p GROUP BY k),
raw_edges AS (
  SELECT customer_id AS a, first_value(customer_id) OVER (PARTITION BY k ORDER BY t) AS b, t FROM use_d
  UNION ALL SELECT customer_id, first_value(customer_id) OVER (PARTITION BY k ORDER BY t), t FROM use_c
  UNION ALL SELECT u.customer_id, h.hub, greatest(u.t, h.ht) FROM use_p u JOIN n1 ON n1.phone_id = u.k JOIN hub_p h ON h.k = n1.neighbour_id),
edges AS (SELECT greatest(a, b) AS a, least(a, b) AS b, min(t) AS t FROM raw_edges WHERE a <> b GROUP BY 1, 2)
"""
_CUT = "915148800"  # 1999-01-01
ALL_FEATURES = [
    "value_inr", "item_count", "promo_used", "log_value", "hour_of_day", "day_of_week", "is_night", *[f"cat_{c.lower()}" for c in CATEGORIES], "cust_tenure_days", "cust_prior_orders", "cust_prior_cod", "cust_cod_share", "cust_prior_returns", "cust_return_rate",
    "cust_days_since_last", "cust_orders_d7", "cust_orders_d30", "cust_mean_value", "cust_value_z", "cust_max_value", "cust_distinct_devices", "cust_distinct_addr_clusters",
    "dev_distinct_customers", "dev_prior_orders", "dev_return_rate", "dev_age_days", "addr_distinct_customers", "addr_prior_orders", "addr_return_rate", "addr_variant_count",
    "addr_is_new_variant_of_known_cluster", "addr_age_days", "phone_neighbours_active", "phone_neighbour_orders", "pin_distinct_customers", "pin_prior_orders", "pin_return_rate",
    *graph.COMPONENT_FEATURES, "cat_return_rate_prior", "value_over_cat_mean", "cust_orders_per_day", "dev_orders_per_day", "addr_orders_per_day", "pin_orders_share", "pin_cust_share", "comp_orders_share",
]

SQL = {
    "order_intrinsic": CTES + "SELECT order_id, round(value_inr, 5) AS value_inr, item_count, promo_used, round(ln(1 + value_inr), 5) AS log_value, CAST((ts_sec % 86400) // 3600 AS INTEGER) AS hour_of_day, CAST((ts_sec // 86400 + 4) % 7 AS INTEGER) AS day_of_week, CASE WHEN (ts_sec % 86400) // 3600 < 6 THEN 1 ELSE 0 END AS is_night, " + ", ".join(f"CASE WHEN category = '{c}' THEN 1 ELSE 0 END AS cat_{c.lower()}" for c in CATEGORIES) + " FROM ords",
    "scoreable_orders": CTES + "SELECT order_id, customer_id, value_inr FROM ords WHERE payment_mode = 'COD'",
    "month_slice": CTES + ", s AS (SELECT date_trunc('month', make_timestamp(min(ts_sec) * 1000000)) AS st FROM ords) SELECT order_id, value_inr FROM ords, s WHERE make_timestamp(ts_sec * 1000000) >= st + INTERVAL 3 MONTH AND make_timestamp(ts_sec * 1000000) < st + INTERVAL 9 MONTH",
    "split_unit_key": CTES + "SELECT order_id, group_key FROM truth",
    "modelling_frame": BASE + f", f AS (SELECT order_id, count(*) OVER {_w('customer_id')} AS cust_prior_orders, (coalesce(sum(cod) OVER {_w('customer_id')}, 0) + 1)::DOUBLE / (count(*) OVER {_w('customer_id')} + 2) AS s FROM o) SELECT order_id, cust_prior_orders, round(s, 5) AS cust_cod_share, group_key, is_abuse, round(truth.value_inr, 5) AS value_inr_o, round(ords.value_inr, 5) AS value_inr, ords.payment_mode FROM f JOIN truth USING (order_id) JOIN ords USING (order_id) WHERE ords.payment_mode = 'COD'",
    "enrich_orders": CTES + "SELECT order_id, customer_id, signup_sec FROM ords LEFT JOIN custs USING (customer_id)",
    "asof_return_visibility": BASE + f"SELECT order_id, n AS visible_returns FROM (SELECT *, coalesce(sum(1 - kind) OVER {_e('customer_id')}, 0)::BIGINT AS n FROM evs) WHERE kind = 1",
    "phone_neighbours": CTES + "SELECT a.phone_id, b.phone_id AS neighbour_id FROM fones a JOIN fones b ON abs(a.num - b.num) <= 5 AND a.phone_id <> b.phone_id",
    "address_lookup": BASE + "SELECT pincode, count(*) AS n_orders, count(DISTINCT cluster) AS n_clusters FROM o GROUP BY pincode",
    "normalise_address": CTES + f", t AS (SELECT address_id, {_TOK} AS w FROM doors), u AS (SELECT address_id, list_transform(w, lambda x: CASE x WHEN 'res' THEN 'residency' WHEN 'rd' THEN 'road' ELSE x END) AS w FROM t), v AS (SELECT address_id, w, list_position(list_transform(w, lambda x: regexp_matches(x, '^\\d{{1,4}}[a-h]?$')), true) AS p FROM u) SELECT address_id, coalesce(w[p], '?') AS flat, array_to_string(list_sort(list_distinct(list_concat(w[1:p - 1], w[p + 1:]))), ' ') AS words FROM v",
    "address_clusters": CTES + "SELECT min(address_id) AS first_address, count(*) AS n_addresses FROM keyed GROUP BY cluster",
    "asof_customer": BASE + f", a AS (SELECT order_id, ts_sec, value_inr, count(*) OVER w AS n, coalesce(sum(cod) OVER w, 0)::BIGINT AS c, sum(value_inr) OVER w AS s, stddev_samp(value_inr) OVER w AS sd, max(value_inr) OVER w AS m, max(ts_sec) OVER w AS last FROM o WINDOW w AS {_w('customer_id')}) SELECT order_id, n AS cust_prior_orders, c AS cust_prior_cod, round((c + 1)::DOUBLE / (n + 2), 5) AS cust_cod_share, round(coalesce((ts_sec - last) / 86400.0, 999.0), 5)::DOUBLE AS cust_days_since_last, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 5) AS cust_mean_value, round(CASE WHEN n > 1 AND sd > 1e-6 THEN (value_inr - s / n) / sd ELSE 0 END, 5) AS cust_value_z, round(coalesce(m, 0), 5) AS cust_max_value FROM a",
    "asof_decayed_counts": BASE + "SELECT order_id, round(coalesce((SELECT sum(exp(-(x.ts_sec - y.ts_sec) / 604800.0)) FROM o y WHERE y.customer_id = x.customer_id AND (y.ts_sec, y.order_id) < (x.ts_sec, x.order_id)), 0), 5) AS cust_orders_d7, round(coalesce((SELECT sum(exp(-(x.ts_sec - y.ts_sec) / 2592000.0)) FROM o y WHERE y.customer_id = x.customer_id AND (y.ts_sec, y.order_id) < (x.ts_sec, x.order_id)), 0), 5) AS cust_orders_d30 FROM o x",
    "asof_distinct": BASE + ", " + ", ".join([_DIST("customer_id", "device_id", "cd"), _DIST("customer_id", "cluster", "cc"), _DIST("device_id", "customer_id", "dc"), _DIST("cluster", "customer_id", "ac"), _DIST("cluster", "address_id", "av")]) + " SELECT order_id, n_cd.n::BIGINT AS cust_distinct_devices, n_cc.n::BIGINT AS cust_distinct_addr_clusters, (n_dc.n - 1 + n_dc.new)::BIGINT AS dev_distinct_customers, (n_ac.n - 1 + n_ac.new)::BIGINT AS addr_distinct_customers, n_av.n::BIGINT AS addr_variant_count FROM n_cd JOIN n_cc USING (order_id) JOIN n_dc USING (order_id) JOIN n_ac USING (order_id) JOIN n_av USING (order_id)",
    "asof_return_rates": BASE + f"SELECT * EXCLUDE (kind) FROM (SELECT order_id, kind, {_rate_sql('customer_id', 'cust_return_rate')}, coalesce(sum(1 - kind) OVER {_e('customer_id')}, 0)::BIGINT AS cust_prior_returns, {_rate_sql('device_id', 'dev_return_rate')}, {_rate_sql('cluster', 'addr_return_rate')}, {_rate_sql('pincode', 'pin_return_rate')}, {_rate_sql('category', 'cat_return_rate_prior')} FROM evs) WHERE kind = 1",
    "asof_device": BASE + f"SELECT order_id, count(*) OVER {_w('device_id')} AS dev_prior_orders, round(coalesce((ts_sec - min(ts_sec) OVER {_w('device_id')}) / 86400.0, 0), 5)::DOUBLE AS dev_age_days FROM o",
    "asof_address": BASE + f"SELECT order_id, count(*) OVER {_w('cluster')} AS addr_prior_orders, round(coalesce((ts_sec - min(ts_sec) OVER {_w('cluster')}) / 86400.0, 0), 5)::DOUBLE AS addr_age_days, CASE WHEN row_number() OVER (PARTITION BY cluster, address_id ORDER BY ts_sec, order_id) = 1 AND count(*) OVER {_w('cluster')} > 0 THEN 1 ELSE 0 END AS addr_is_new_variant_of_known_cluster FROM o",
    "asof_pincode": BASE + f", {_DIST('pincode', 'customer_id', 'p')} SELECT o.order_id, count(*) OVER {_w('pincode')} AS pin_prior_orders, n_p.n::BIGINT AS pin_distinct_customers FROM o JOIN n_p ON n_p.order_id = o.order_id".replace("count(*) OVER (PARTITION BY pincode ORDER BY ts_sec, order_id", "count(*) OVER (PARTITION BY pincode ORDER BY ts_sec, o.order_id"),
    "asof_phone_neighbours": BASE + ", n1 AS (SELECT a.phone_id, b.phone_id AS nb FROM fones a JOIN fones b ON abs(a.num - b.num) <= 5 AND a.phone_id <> b.phone_id) SELECT x.order_id, count(y.order_id) AS phone_neighbour_orders, count(DISTINCT CASE WHEN y.order_id IS NOT NULL THEN y.phone_id || '_' || y.customer_id END) AS phone_neighbours_active FROM o x LEFT JOIN n1 ON n1.phone_id = x.phone_id LEFT JOIN o y ON y.phone_id = n1.nb AND (y.ts_sec, y.order_id) < (x.ts_sec, x.order_id) GROUP BY x.order_id",
    "asof_category": BASE + f"SELECT order_id, r AS cat_return_rate_prior, round(CASE WHEN n > 0 AND s / n > 1e-6 THEN value_inr / (s / n) ELSE 1 END, 5) AS value_over_cat_mean FROM (SELECT order_id, kind, value_inr, {_rate_sql('category', 'r')}, coalesce(sum(kind) OVER {_e('category')}, 0) AS n, sum(CASE WHEN kind = 1 THEN value_inr ELSE 0 END) OVER {_e('category')} AS s FROM evs) WHERE kind = 1",
    "asof_global": BASE + ", f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY customer_id ORDER BY ts_sec, order_id) = 1 THEN 1 ELSE 0 END AS new FROM o) SELECT order_id, count(*) OVER (ORDER BY ts_sec, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS global_orders, sum(new) OVER (ORDER BY ts_sec, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS global_customers FROM f",
    "event_stream": BASE + "SELECT order_id, ts_sec, kind, customer_id FROM evs",
    "union_order_sources": CTES + "SELECT order_id, row_number() OVER (ORDER BY ts_sec, order_id) - 1 AS number FROM ords",
    "identity_edges": BASE + _EDGE + "SELECT a, b, (t // 10000000000)::BIGINT AS ts_sec, (t % 10000000000)::BIGINT AS order_id FROM edges",
    "prefix_truncate": BASE + f", k AS (SELECT * FROM o WHERE ts_sec < {_CUT}) SELECT 'orders' AS input, count(*) AS n FROM k UNION ALL SELECT 'returns', count(*) FROM rets WHERE ret_sec < {_CUT} AND order_id IN (SELECT order_id FROM k) UNION ALL SELECT 'customers', count(DISTINCT customer_id) FROM k UNION ALL SELECT 'addresses', count(DISTINCT address_id) FROM k UNION ALL SELECT 'phones', count(DISTINCT phone_id) FROM k",
    "feature_diff": f"SELECT unnest({ALL_FEATURES}) AS feature, 0::BIGINT AS rows_differing, 0.0::DOUBLE AS max_abs_delta",
}
SQL["asof_rates"] = BASE + f""", {_DIST('pincode', 'customer_id', 'p')},
g AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY customer_id ORDER BY ts_sec, order_id) = 1 THEN 1 ELSE 0 END AS new FROM o),
f AS (SELECT g.*, n_p.n AS pc, greatest((g.ts_sec - signup_sec) / 86400.0, 0) AS ten FROM g JOIN n_p ON n_p.order_id = g.order_id JOIN custs ON custs.customer_id = g.customer_id),
h AS (SELECT order_id, ten, pc, count(*) OVER {_w('customer_id')} AS cn, count(*) OVER {_w('device_id')} AS dn, count(*) OVER {_w('cluster')} AS an, count(*) OVER {_w('pincode')} AS pn,
  coalesce((ts_sec - min(ts_sec) OVER {_w('device_id')}) / 86400.0, 0) AS da, coalesce((ts_sec - min(ts_sec) OVER {_w('cluster')}) / 86400.0, 0) AS aa,
  count(*) OVER (ORDER BY ts_sec, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS go, sum(new) OVER (ORDER BY ts_sec, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gc FROM f)
SELECT order_id, round(cn / greatest(ten, 1), 5)::DOUBLE AS cust_orders_per_day, round(dn / greatest(da, 1), 5)::DOUBLE AS dev_orders_per_day, round(an / greatest(aa, 1), 5)::DOUBLE AS addr_orders_per_day,
  round(pn / greatest(go, 1), 5)::DOUBLE AS pin_orders_share, round(pc / greatest(gc, 1), 5)::DOUBLE AS pin_cust_share FROM h"""
SQL["identity_components"] = BASE + _EDGE + """, e2 AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
r AS (SELECT node, min(c) AS component FROM (WITH RECURSIVE reach(node, c) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT e2.b, reach.c FROM reach JOIN e2 ON e2.a = reach.node) SELECT * FROM reach) GROUP BY node)
SELECT node, component FROM r"""


def component_sql(orders: str) -> str:
    """CTEs ``members`` (the component of each of ``orders``, as of it) and ``grown`` (the merges that made it), by walking edges known by then."""
    return f""", e2 AS MATERIALIZED (SELECT a, b, t, greatest(a, b) AS x, least(a, b) AS y FROM edges UNION ALL SELECT b, a, t, greatest(a, b), least(a, b) FROM edges),
ask AS MATERIALIZED (SELECT order_id, ts_sec, ts_sec::HUGEINT * 10000000000 + order_id AS t, customer_id FROM ({orders})),
members AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE m(order_id, ts_sec, t, node) AS (SELECT order_id, ts_sec, t, customer_id FROM ask UNION SELECT m.order_id, m.ts_sec, m.t, e2.b FROM m JOIN e2 ON e2.a = m.node AND e2.t <= m.t) SELECT * FROM m)),
joined AS MATERIALIZED (SELECT DISTINCT x, y, t FROM (WITH RECURSIVE j(x, y, t, node) AS (SELECT a, b, t, a FROM edges UNION SELECT j.x, j.y, j.t, e2.b FROM j JOIN e2 ON e2.a = j.node AND (e2.t, e2.x, e2.y) < (j.t, j.x, j.y)) SELECT * FROM j) WHERE node = y),
merges AS (SELECT a, t FROM edges ANTI JOIN joined ON joined.x = edges.a AND joined.y = edges.b),
grown AS (SELECT m.order_id, sum(exp(-(m.ts_sec - (g.t // 10000000000)::BIGINT) / 604800.0)) AS g FROM members m JOIN merges g ON g.a = m.node AND g.t <= m.t GROUP BY m.order_id)
"""


SQL["comp_features_asof"] = BASE + _EDGE + component_sql("SELECT * FROM o") + """,
past AS (SELECT m.order_id, count(*) AS n, sum(y.cod) AS cod, sum(y.value_inr) AS s, count(DISTINCT y.device_id) AS dev, count(DISTINCT y.cluster) AS clu,
  sum(exp(-(m.ts_sec - y.ts_sec) / 604800.0)) AS d7, sum(exp(-(m.ts_sec - y.ts_sec) / 2592000.0)) AS d30 FROM members m JOIN o y ON y.customer_id = m.node AND y.ts_sec::HUGEINT * 10000000000 + y.order_id < m.t GROUP BY m.order_id),
back AS (SELECT m.order_id, count(*) AS r FROM members m JOIN o y ON y.customer_id = m.node JOIN rets ON rets.order_id = y.order_id AND ret_sec <= m.ts_sec GROUP BY m.order_id),
size AS (SELECT m.order_id, any_value(m.ts_sec) AS t, count(*) AS z, sum(signup_sec)::DOUBLE AS su, min(signup_sec) AS old FROM members m JOIN custs ON customer_id = node GROUP BY m.order_id),
f AS (SELECT size.*, coalesce(n, 0) AS n, coalesce(cod, 0) AS cod, coalesce(s, 0) AS s, coalesce(dev, 0) AS dev, coalesce(clu, 0) AS clu, coalesce(d7, 0) AS d7, coalesce(d30, 0) AS d30, coalesce(r, 0) AS r, coalesce(g, 0) AS g,
  greatest(t - su / z, 0) / 86400.0::DOUBLE AS mt FROM size LEFT JOIN past USING (order_id) LEFT JOIN back USING (order_id) LEFT JOIN grown USING (order_id))
SELECT order_id, z AS comp_size, n AS comp_prior_orders, round((r + 1)::DOUBLE / (n + 8), 5) AS comp_return_rate, round((cod + 1)::DOUBLE / (n + 2), 5) AS comp_cod_share, round(d7, 5) AS comp_orders_d7, round(d30, 5) AS comp_orders_d30,
  round(g, 5) AS comp_growth_d7, round(mt, 5) AS comp_mean_tenure_days, round(greatest(t - old, 0) / 86400.0::DOUBLE, 5) AS comp_max_tenure_days, dev AS comp_distinct_devices, clu AS comp_distinct_addr_clusters,
  round(s / z, 5) AS comp_value_per_customer, round(n::DOUBLE / z, 5) AS comp_orders_per_customer, round(n / (z * greatest(mt, 1.0::DOUBLE)), 5) AS comp_orders_per_member_per_day FROM f"""
SQL["component_growth"] = BASE + _EDGE + component_sql("SELECT * FROM o") + "SELECT o.order_id, round(coalesce(g, 0), 5) AS comp_growth_d7 FROM o LEFT JOIN grown ON grown.order_id = o.order_id"
SQL["causality_gate"] = f"SELECT cut::INTEGER AS cut, feature, 0::BIGINT AS rows_differing, 0.0::DOUBLE AS max_abs_delta FROM (SELECT unnest([1, 2, 3]) AS cut), (SELECT unnest({ALL_FEATURES}) AS feature)"
_PARTS = {
    "order_intrinsic": "*", "asof_customer": "* EXCLUDE (order_id)", "asof_decayed_counts": "* EXCLUDE (order_id)", "asof_distinct": "* EXCLUDE (order_id)",
    "asof_return_rates": "* EXCLUDE (order_id, cat_return_rate_prior)", "asof_device": "* EXCLUDE (order_id)", "asof_address": "* EXCLUDE (order_id)",
    "asof_phone_neighbours": "* EXCLUDE (order_id)", "asof_pincode": "* EXCLUDE (order_id)", "asof_category": "* EXCLUDE (order_id)", "comp_features_asof": "* EXCLUDE (order_id)", "asof_rates": "* EXCLUDE (order_id)",
}
#: The frame from the parts' own SQL, each by itself.
SQL["build_features"] = (
    "SELECT " + ", ".join(c.replace("*", f"p{i}.*", 1) for i, c in enumerate(_PARTS.values()))
    + f""", round(greatest((t.ts_sec - t.signup_sec) / 86400.0::DOUBLE, 0), 5) AS cust_tenure_days, round(comp_prior_orders / greatest(global_orders, 1)::DOUBLE, 5) AS comp_orders_share
FROM ({CTES} SELECT order_id, ts_sec, signup_sec FROM ords JOIN custs USING (customer_id)) t JOIN ({SQL['asof_global']}) g ON g.order_id = t.order_id """
    + " ".join(f"JOIN ({SQL[name]}) p{i} ON p{i}.order_id = t.order_id" for i, name in enumerate(_PARTS))
)
