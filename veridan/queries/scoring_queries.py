"""Scoring, explanation and streaming over the driver tables."""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from ..operators import asof, features, graph
from ..operators.tables import passing
from ..plans import explain, model, splits
from ..sources.driver_tables import table, world
from ..streaming.features import run_to_table, stream_features
from .asof_queries import BASE, CATEGORIES, _inputs, _o, _rounded, _w
from .decision_queries import HI, LO

def _frame(spark, sf_dir):
    """COD orders with all features, label, and a split of whole groups; and the names of the features that do not grow with
    the age of the data. The features are joined where they were put together, by order_id."""
    w = world(spark, sf_dir)
    w["truth"] = graph.stored(w["truth"], "truth")  # read twice
    f = features.build_features(**_inputs(w), categories=CATEGORIES)
    t = w["truth"].where("payment_mode = 'COD'").select("order_id", "customer_id", "category", "group_key", "is_abuse")
    t = t.join(splits.group_split(w["truth"]), "group_key").drop("group_key")
    return t.join(f, "order_id"), features.feature_set([c for c in f.columns if c != "order_id"], "stable")


#: The tables that the frame is made of.
_INPUTS = ("orders", "lineitem", "part", "customer")


def _state(spark, sf_dir) -> str:
    """A name for the inputs as they are: it changes with any of their files."""
    conf, every = spark._jsc.hadoopConfiguration(), []
    for name in _INPUTS:
        for uri in table(spark, sf_dir, name).inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            status = path.getFileSystem(conf).getFileStatus(path)
            every.append(f"{uri} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(every)).encode()).hexdigest()[:32]


def _fitted(spark, sf_dir):
    """Frame, features and model: read from where an earlier query saved them for the inputs as they are, else made and saved."""
    graph.scratch(spark, "scoring")  # sets the shared folder where a local session names none
    base = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/scoring-{_state(spark, sf_dir)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/columns/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        with passing(spark):  # of all tables only the frame lasts
            frame, columns = _frame(spark, sf_dir)
            frame.write.mode("overwrite").parquet(f"{base}/frame")
        with passing(spark):
            # In order of id, as sampling goes by place.
            train = spark.read.parquet(f"{base}/frame").where("split = 'train'").orderBy("order_id")
            model.train_scorer(train, columns, trees=20).write().overwrite().save(f"{base}/model")
        # Last, as it tells that the others are whole.
        spark.createDataFrame([(columns,)], "columns array<string>").coalesce(1).write.mode("overwrite").parquet(f"{base}/columns")
    columns = list(spark.read.parquet(f"{base}/columns").first()[0])
    return spark.read.parquet(f"{base}/frame"), columns, GBTClassificationModel.load(f"{base}/model")


def _banded(frame, columns, m):
    """The test fold with p and band; the calibration comes from the validation fold."""
    iso = model.calibrate(model.raw_scores(m, frame.where("split = 'val'"), columns))
    return model.score_orders(m, iso, frame.where("split = 'test'"), columns, LO, HI)


def train_scorer(spark, sf_dir):
    """Raw scores of the validation fold by trees fitted on the train fold."""
    frame, columns, m = _fitted(spark, sf_dir)
    return _rounded(model.raw_scores(m, frame.where("split = 'val'"), columns).select("order_id", "is_abuse", "raw_p"))


def calibrate_scorer(spark, sf_dir):
    """Boundaries and values of the isotonic map fitted on the validation fold."""
    frame, columns, m = _fitted(spark, sf_dir)
    iso = model.calibrate(model.raw_scores(m, frame.where("split = 'val'"), columns))
    return spark.createDataFrame(list(zip(iso.boundaries.toArray().tolist(), iso.predictions.toArray().tolist(), strict=True)), "raw_p double, p double")


def score_orders(spark, sf_dir):
    return _rounded(_banded(*_fitted(spark, sf_dir)).select("order_id", "is_abuse", "p", "band"))


def feature_importance(spark, sf_dir):
    _, columns, m = _fitted(spark, sf_dir)
    return spark.createDataFrame([(i, f, g) for i, (f, g) in enumerate(model.feature_importance(m, columns))], "rank int, feature string, gain double")


def tree_attribution(spark, sf_dir):
    """Exact attribution of every flagged order of the test fold, a row a feature."""
    return _flagged(spark, sf_dir)[1]


def _flagged(spark, sf_dir):
    """The flagged orders of the test fold with all their features, and the attribution of their scores."""
    frame, columns, m = _fitted(spark, sf_dir)
    with passing(spark) as keep:
        flagged = keep(graph.stored(_banded(frame, columns, m).where("band <> 'pass'"), "flagged"))
    return flagged, model.tree_attribution(m, flagged, columns)


def flagged_evidence(spark, sf_dir):
    """Of every flagged order the five strongest contributions for its score and the two against it, as sentences without repetition."""
    e = explain.top_evidence(_flagged(spark, sf_dir)[1])
    says = lambda c: F.array_join(F.array_distinct(F.transform(c, lambda x: x["sentence"])), "; ")
    return e.select("order_id", says("evidence").alias("evidence"), says("counter_evidence").alias("counter_evidence"), F.size("evidence").alias("n_evidence"))


def flagged_sentences(spark, sf_dir):
    """A sentence for each feature of each flagged order, from the feature's own value."""
    a = _flagged(spark, sf_dir)[1]
    return a.select("order_id", "feature", explain.sentence(F.col("feature"), F.col("value")).alias("sentence"))


def flagged_caveats(spark, sf_dir):
    """What the flag of each order does not establish, from its own component, door, phone and history."""
    return _flagged(spark, sf_dir)[0].select("order_id", F.array_join(explain.caveats(), " ").alias("caveats"))


def _attributions(spark, sf_dir):
    """Stand-in contributions that SQL can make too: each feature's value against its typical one."""
    w, o = _o(spark, sf_dir)
    c = asof.asof_customer(o).select("order_id", "cust_prior_orders", "cust_cod_share", "cust_mean_value", "cust_days_since_last", "cust_max_value")
    typical = {"cust_prior_orders": (8.0, 10.0), "cust_cod_share": (0.6, 0.2), "cust_mean_value": (240000.0, 90000.0), "cust_days_since_last": (120.0, 100.0), "cust_max_value": (380000.0, 90000.0)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value"), ((F.col(k) - m) / s).alias("contribution")) for k, (m, s) in typical.items()]))
    return c.select("order_id", rows.alias("r")).select("order_id", "r.feature", "r.value", "r.contribution")


def top_evidence(spark, sf_dir):
    e = explain.top_evidence(_attributions(spark, sf_dir), 3, 2)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["feature"]), ",")
    return e.select("order_id", names("evidence").alias("up"), names("counter_evidence").alias("down"))


def evidence_sentences(spark, sf_dir):
    a = _attributions(spark, sf_dir).withColumn("value", F.round("value", 4))
    return a.select("order_id", "feature", explain.sentence(F.col("feature"), F.col("value")).alias("sentence"))


def dedupe_sentences(spark, sf_dir):
    """Number of distinct sentences among each order's strongest contributions; the cart's value and its logarithm say the same."""
    cart = _o(spark, sf_dir)[1].select("order_id", F.floor("value_inr").cast("double").alias("v"))
    both = F.explode(F.array(F.struct(F.lit("value_inr").alias("feature"), F.col("v").alias("value")), F.struct(F.lit("log_value").alias("feature"), F.log1p("v").alias("value")))).alias("r")
    cart = cart.select("order_id", ((F.col("v") - 150000) / 70000).alias("contribution"), both).select("order_id", "r.feature", "r.value", "contribution")
    e = explain.top_evidence(_attributions(spark, sf_dir).unionByName(cart))
    return e.select("order_id", F.size(F.array_distinct(F.transform("evidence", lambda x: x["sentence"]))).alias("n_sentences"))


def _facts(spark, sf_dir):
    w, o = _o(spark, sf_dir)
    f = asof.asof_customer(o).select("order_id", "cust_prior_orders").join(asof.asof_distinct(o).select("order_id", "addr_distinct_customers"), "order_id")
    f = f.join(asof.asof_address(o).select("order_id", "addr_is_new_variant_of_known_cluster", "addr_age_days"), "order_id").join(asof.asof_phone_neighbours(o, w["phones"]), "order_id")
    # The age of the door stands in for the component's here, so that SQL can follow.
    return f.withColumn("comp_max_tenure_days", F.col("addr_age_days")).withColumn("comp_size", F.col("addr_distinct_customers") + 1)


def caveats(spark, sf_dir):
    return _facts(spark, sf_dir).select("order_id", F.array_join(explain.caveats(), " ").alias("caveats"))


def explanation_payload(spark, sf_dir):
    """Payload of every flagged order of the test fold, from the attribution of its own score and its own features."""
    flagged, a = _flagged(spark, sf_dir)
    return explain.payload(flagged.select("order_id", "customer_id", "value_inr", "category", "p", "band"), explain.top_evidence(a), flagged)


def _stream_events(spark, sf_dir, item: str, slices: int = 2):
    """The events table as a stream, purchases as orders and errors as returns; and the bound of its lateness.

    It lands in ``slices`` of equal time, one after the other, and in any order inside a slice; about half the files of
    a slice come in one trigger. So a row can be late by a slice at most. A heartbeat closes the stream.
    """
    events = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    events = events.select(
        F.col("event_id").alias("order_id"), F.expr("timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)))").alias("ts"),
        F.expr("if(event_type = 'purchase', 1, 0)").alias("kind"), F.col("user_id").alias("key") if item == "value" else F.expr("user_id % 20").alias("key"),
        F.expr("cast(floor(value) AS long)").alias("item") if item == "value" else F.col("user_id").alias("item"), F.coalesce("value", F.lit(0.0)).alias("value"), F.expr("int(event_id % 2)").alias("cod"),
    )
    landing = graph.scratch(spark, "landing")  # a folder, as a file stream needs one
    low, high = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    low, high = (low, high) if low is not None else (0, 0)
    width = (high - low) // slices + 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    place = F.unix_seconds("ts")
    for i in range(slices):
        events.where((place >= low + i * width) & (place < low + (i + 1) * width)).repartition(parts, "order_id").write.mode("append").parquet(landing)
    end = events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    beat = spark.range(1).select(F.timestamp_seconds(F.lit(high + 2 * width + 60)).alias("ts"), F.lit(2).alias("kind"), F.lit(-1).alias("key"))
    spark.createDataFrame([], end).unionByName(beat, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(landing)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", (parts + 1) // 2).parquet(landing), f"{width + 1} seconds"


def _streamed(spark, sf_dir, item: str):
    out = stream_features(*_stream_events(spark, sf_dir, item))
    return _rounded(run_to_table(out, graph.scratch(spark, "stream"), graph.scratch(spark, "stream-checkpoint")), 4)


def stream_customer_features(spark, sf_dir):
    return _streamed(spark, sf_dir, "value")


def stream_entity_features(spark, sf_dir):
    return _streamed(spark, sf_dir, "user")


def stream_return_settlement(spark, sf_dir):
    """Returns that are visible at each order, from the stream."""
    return _streamed(spark, sf_dir, "value").select("order_id", "key", "prior_returns")


QUERIES = {f.__name__: f for f in (
    train_scorer, calibrate_scorer, score_orders, feature_importance, tree_attribution, top_evidence, evidence_sentences, dedupe_sentences, caveats,
    flagged_evidence, flagged_sentences, flagged_caveats, explanation_payload, stream_customer_features, stream_entity_features, stream_return_settlement,
)}

_W = _w("customer_id")
_ATT = BASE + f""", a AS (SELECT order_id, ts_sec, count(*) OVER {_W} AS n, coalesce(sum(cod) OVER {_W}, 0) AS c, sum(value_inr) OVER {_W} AS s, coalesce(max(value_inr) OVER {_W}, 0) AS m, max(ts_sec) OVER {_W} AS last FROM o),
v AS (SELECT order_id, n::DOUBLE AS cust_prior_orders, (c + 1)::DOUBLE / (n + 2) AS cust_cod_share, CASE WHEN n > 0 THEN s / n ELSE 0 END AS cust_mean_value, coalesce((ts_sec - last) / 86400.0::DOUBLE, 999.0::DOUBLE) AS cust_days_since_last, m AS cust_max_value FROM a),
r AS (SELECT order_id, 'cust_prior_orders' AS feature, cust_prior_orders AS value, (cust_prior_orders - 8) / 10 AS contribution FROM v UNION ALL SELECT order_id, 'cust_cod_share', cust_cod_share, (cust_cod_share - 0.6::DOUBLE) / 0.2::DOUBLE FROM v
 UNION ALL SELECT order_id, 'cust_mean_value', cust_mean_value, (cust_mean_value - 240000) / 90000 FROM v UNION ALL SELECT order_id, 'cust_days_since_last', cust_days_since_last, (cust_days_since_last - 120) / 100 FROM v
 UNION ALL SELECT order_id, 'cust_max_value', cust_max_value, (cust_max_value - 380000) / 90000 FROM v)"""
_EV = lambda key, item: f"""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS kind, {key} AS k, {item} AS item, coalesce(value, 0) AS value, event_id % 2 AS cod FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT *, CASE WHEN kind = 1 AND row_number() OVER (PARTITION BY k, kind, item ORDER BY t, event_id) = 1 THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, count(*) FILTER (WHERE kind = 1) OVER w AS n, count(*) FILTER (WHERE kind = 0) OVER w AS r, sum(cod) FILTER (WHERE kind = 1) OVER w AS c, sum(value) FILTER (WHERE kind = 1) OVER w AS s, max(t) FILTER (WHERE kind = 1) OVER w AS last, min(t) FILTER (WHERE kind = 1) OVER w AS first, sum(new) OVER w AS di,
  sum(exp((t - 1704067200) / 604800.0)) FILTER (WHERE kind = 1) OVER w AS d7, sum(exp((t - 1704067200) / 2592000.0)) FILTER (WHERE kind = 1) OVER w AS d30 FROM f WINDOW w AS (PARTITION BY k ORDER BY t, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""  # noqa: E731
_ES = """SELECT event_id AS order_id, k AS key, n AS prior_orders, r AS prior_returns, coalesce(c, 0)::BIGINT AS prior_cod, round((r + 1)::DOUBLE / (n + 8), 4) AS return_rate, round(coalesce((t - last) / 86400.0, 999), 4)::DOUBLE AS days_since_last, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 4) AS mean_value,
  round(coalesce(d7 * exp(-(t - 1704067200) / 604800.0), 0), 4) AS orders_d7, round(coalesce(d30 * exp(-(t - 1704067200) / 2592000.0), 0), 4) AS orders_d30, coalesce(di, 0)::BIGINT AS distinct_items, round(coalesce((t - first) / 86400.0, 0), 4)::DOUBLE AS age_days FROM g WHERE kind = 1"""
_FACTS = BASE + f""", n1 AS (SELECT a.phone_id, b.phone_id AS nb FROM fones a JOIN fones b ON abs(a.num - b.num) <= 5 AND a.phone_id <> b.phone_id),
ph AS (SELECT x.order_id, count(DISTINCT CASE WHEN y.order_id IS NOT NULL THEN y.phone_id || '_' || y.customer_id END) AS pa FROM o x LEFT JOIN n1 ON n1.phone_id = x.phone_id LEFT JOIN o y ON y.phone_id = n1.nb AND (y.ts_sec, y.order_id) < (x.ts_sec, x.order_id) GROUP BY x.order_id),
d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY cluster, customer_id ORDER BY ts_sec, order_id) = 1 THEN 1 ELSE 0 END AS new, CASE WHEN row_number() OVER (PARTITION BY cluster, address_id ORDER BY ts_sec, order_id) = 1 THEN 1 ELSE 0 END AS newa FROM o),
fx AS (SELECT order_id, count(*) OVER {_W} AS n, coalesce(sum(new) OVER {_w('cluster')}, 0) - 1 + new AS adc, coalesce((ts_sec - min(ts_sec) OVER {_w('cluster')}) / 86400.0, 0) AS age, newa = 1 AND count(*) OVER {_w('cluster')} > 0 AS variant FROM d)
SELECT order_id, CASE WHEN len(l) = 0 THEN '{explain.NO_CAVEAT}' ELSE array_to_string(l, ' ') END AS caveats FROM (SELECT order_id, list_filter([CASE WHEN n = 0 THEN '{explain.CAVEATS[0][1]}' END, CASE WHEN adc >= 1 AND age > 365 THEN '{explain.CAVEATS[1][1]}' END, CASE WHEN variant THEN '{explain.CAVEATS[2][1]}' END, CASE WHEN adc + 1 <= 1 THEN '{explain.CAVEATS[3][1]}' END, CASE WHEN pa > 0 THEN '{explain.CAVEATS[4][1]}' END], lambda x: x IS NOT NULL) AS l FROM fx JOIN ph USING (order_id))"""

SQL = {
    "top_evidence": _ATT + ", u AS (SELECT order_id, feature, row_number() OVER (PARTITION BY order_id ORDER BY -contribution, feature) AS k FROM r WHERE contribution > 0), w AS (SELECT order_id, feature, row_number() OVER (PARTITION BY order_id ORDER BY -contribution DESC, feature DESC) AS k FROM r WHERE contribution < 0) SELECT order_id, coalesce((SELECT string_agg(feature, ',' ORDER BY k) FROM u WHERE u.order_id = v.order_id AND k <= 3), '') AS up, coalesce((SELECT string_agg(feature, ',' ORDER BY k) FROM w WHERE w.order_id = v.order_id AND k <= 2), '') AS down FROM v",
    "evidence_sentences": _ATT + """SELECT order_id, feature, CASE feature WHEN 'cust_prior_orders' THEN 'the account has ' || value::BIGINT || ' prior orders'
  WHEN 'cust_cod_share' THEN floor(x * 100 + 0.5::DOUBLE)::BIGINT || '% of the account''s prior orders were cash-on-delivery' WHEN 'cust_mean_value' THEN 'the account''s prior orders average Rs ' || floor(x + 0.5::DOUBLE)::BIGINT
  WHEN 'cust_max_value' THEN 'the account''s largest prior order was Rs ' || floor(x + 0.5::DOUBLE)::BIGINT
  ELSE CASE WHEN x > 900 THEN 'this is the account''s first order' ELSE 'the previous order was ' || printf('%.1f', floor(x * 10 + 0.5::DOUBLE) / 10) || ' days ago' END END AS sentence FROM (SELECT *, round(value, 4) AS x FROM r)""",
    "dedupe_sentences": _ATT + """, c AS (SELECT order_id, floor(value_inr)::DOUBLE AS v FROM o), s AS (SELECT order_id, feature, feature AS says, contribution FROM r
  UNION ALL SELECT order_id, 'value_inr', 'cart', (v - 150000) / 70000 FROM c UNION ALL SELECT order_id, 'log_value', 'cart', (v - 150000) / 70000 FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY -contribution, feature) AS k FROM s WHERE contribution > 0)
SELECT o.order_id, CAST(count(DISTINCT says) AS INTEGER) AS n_sentences FROM o LEFT JOIN k ON k.order_id = o.order_id AND k <= 5 GROUP BY o.order_id""",
    "caveats": _FACTS,
    "stream_customer_features": _EV("user_id", "CAST(floor(value) AS BIGINT)") + _ES,
    "stream_entity_features": _EV("user_id % 20", "user_id") + _ES,
    "stream_return_settlement": _EV("user_id", "user_id") + "SELECT event_id AS order_id, k AS key, r AS prior_returns FROM g WHERE kind = 1",
}
