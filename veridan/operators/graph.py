"""The identity graph that grows over time.

An order links its customer to every customer seen before on its device, its address cluster, or a phone
adjacent to its own. Linking each newcomer to the entity's first customer gives the same parts at every
moment with as many edges as newcomers.

A component is known by a label: of its customers the one with the least hash. So the history of all components is a forest:
each customer's label is absorbed once at most, by a lesser one, at the order that merged the two. A customer's labels over time
are the way up that forest, and as the order of the labels is random, it has about as many steps as the logarithm of
the component's size, however the component grew. Events go to each label that their customer bears from then on: to the
one of that time as they happen, to later ones at the merge. Then the features of as-of components are prefix sums
over a label's events (``operators.scan``), and no component is gathered anywhere.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY, seconds
from .asof import AFTER, AHEAD, SELF, TAU7, TAU30, first_uses, latest_returns, near_numbers, phone_numbers
from .scan import Prefix, prefix, ranked
from .tables import connected_components, dropped, scratch, stored  # noqa: F401

#: Edges of a stretch of time that one task goes through.
STRETCH = 500_000


def _stars(orders: DataFrame, key: str) -> DataFrame:
    """Edge of each newcomer on the key to its first customer, at the newcomer's first order."""
    use = orders.where(F.col(key).isNotNull()).groupBy(key, "customer_id").agg(F.min(F.struct("ts_sec", "order_id")).alias("at"))
    hub = use.groupBy(key).agg(F.min(F.struct("at", "customer_id")).alias("hub"))
    e = use.join(hub, key).where(F.col("customer_id") != F.col("hub.customer_id"))
    return e.select(F.col("customer_id").alias("a"), F.col("hub.customer_id").alias("b"), "at.ts_sec", "at.order_id")


def _phone_edges(orders: DataFrame, phones: DataFrame) -> DataFrame:
    """Edges between customers on adjacent phones, by number: few for each use of a phone, however many phones share a number."""
    n = phone_numbers(phones)
    use = first_uses(orders.join(n, "phone_id"), ["phone_id", "num", "several"], ["customer_id"]).withColumn("at", F.struct("ts_sec", "order_id"))
    use = use.select("num", "several", "phone_id", "customer_id", "at")
    hub = use.groupBy(F.col("num").alias("near")).agg(F.min(F.struct("at", "customer_id", "phone_id")).alias("hub"))
    # Phones of one number are adjacent, one phone's customers are not by that alone: the first use by another phone is a second hub.
    again = use.where("several").join(hub, F.col("num") == F.col("near")).where("phone_id <> hub.phone_id").groupBy(F.col("num").alias("near")).agg(F.min(F.struct("at", "customer_id", "phone_id")).alias("hub"))
    far = use.join(near_numbers(n), "num").join(hub, "near")
    same = use.where("several").join(hub.unionByName(again), F.col("num") == F.col("near")).where("phone_id <> hub.phone_id")
    cols = ["customer_id", "at", "hub"]
    e = far.select(*cols).unionByName(same.select(*cols)).where(F.col("customer_id") != F.col("hub.customer_id")).withColumn("when", F.greatest("at", "hub.at"))
    return e.select(F.col("customer_id").alias("a"), F.col("hub.customer_id").alias("b"), "when.ts_sec", "when.order_id")


def identity_edges(orders: DataFrame, phones: DataFrame) -> DataFrame:
    """(a, b, ts_sec, order_id): links between customers and the order that made each."""
    every = _stars(orders, "device_id").unionByName(_stars(orders, "cluster")).unionByName(_phone_edges(orders, phones))
    pair = every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "ts_sec", "order_id")
    return pair.groupBy("a", "b").agg(F.min(F.struct("ts_sec", "order_id")).alias("m")).select("a", "b", "m.ts_sec", "m.order_id")


COMPONENT_FEATURES = [
    "comp_size", "comp_prior_orders", "comp_return_rate", "comp_cod_share", "comp_orders_d7", "comp_orders_d30", "comp_growth_d7",
    "comp_mean_tenure_days", "comp_max_tenure_days", "comp_distinct_devices", "comp_distinct_addr_clusters", "comp_value_per_customer",
    "comp_orders_per_customer", "comp_orders_per_member_per_day",
]


def _walk(edges: pd.DataFrame) -> pd.DataFrame:
    """One stretch of time: each label that is absorbed in it, with its way up, in order of time.

    ``edges``: a and b (labels at the stretch's begin), their hashes, and the order that links them.
    """
    edges = edges.sort_values(["ts_sec", "order_id", "a", "b"], kind="stable")
    ids, places = np.unique(np.concatenate((edges["a"], edges["b"])), return_inverse=True)
    hashes = np.empty(len(ids), np.int64)
    hashes[places] = np.concatenate((edges["ha"], edges["hb"]))
    order = np.lexsort((ids, hashes))  # numbers in the order of labels: of two the less absorbs
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    ids = ids[order].tolist()
    up = list(range(len(ids)))
    to: dict[int, tuple[int, int, int]] = {}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    n = len(edges)
    for a, b, ts, order_id in zip(number[places[:n]].tolist(), number[places[n:]].tolist(), edges["ts_sec"].tolist(), edges["order_id"].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            a, b = max(a, b), min(a, b)
            up[a] = b
            to[a] = (b, ts, order_id)
    rows = []
    for x in to:
        way, at = [], x
        while at in to:
            at, ts, order_id = to[at]
            way.append({"label": ids[at], "ts_sec": ts, "order_id": order_id})
        rows.append((ids[x], way))
    return pd.DataFrame(rows, columns=["customer_id", "way"])


_WAY = "customer_id long, way array<struct<label: long, ts_sec: long, order_id: long>>"


def label_ways(edges: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(customer_id, way): the labels that replace the customer's own one after the other, each with the order from which on it holds.

    Customers that keep their own label are absent. Edges go by time into stretches of ``stretch`` at most. For each but the
    first, the edges' ends are replaced by the labels at its begin: halves are split in halves, and what is in the right half of
    each is replaced by the components of the left half, all halves of a level at once. Edges within one component
    fall away. Then each stretch is walked by itself, and the ways that go on in later ones are put together.
    """
    e = edges.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"), "ts_sec", "order_id")
    levels = max(0, math.ceil(math.log2(max(edges.count(), 1) / stretch)))
    if levels:
        e = ranked(e, [], [F.col("ts_sec"), F.col("order_id"), F.col("a"), F.col("b")], "edge-ranks")
        e = stored(e.withColumn("block", F.expr(f"_rank * {1 << levels} div _total")).drop("_rank", "_total"), "edge-blocks")
    else:
        e = e.withColumn("block", F.lit(0).cast("long"))
    for level in range(levels):
        half = levels - level - 1
        e = e.withColumns({"q": F.shiftright("block", half + 1), "right": F.shiftright("block", half).bitwiseAND(F.lit(1)) == 1})
        node = lambda x: F.struct("q", F.col(f"h{x}").alias("h"), F.col(x).alias("id"))
        found = connected_components(e.where("NOT right").select(node("a").alias("a"), node("b").alias("b")))
        found = stored(found.where("node <> component").select("node.q", F.col("node.id").alias("from"), F.col("component.id").alias("to"), F.col("component.h").alias("hash")), "labels")
        late = e.where("right")
        for x in ("a", "b"):
            names = found.select(F.col("q").alias("_q"), F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("hash").alias("_hash"))
            late = late.join(names, (F.col("q") == F.col("_q")) & (F.col(x) == F.col("_from")), "left")
            late = late.withColumns({x: F.coalesce("_to", x), f"h{x}": F.coalesce("_hash", f"h{x}")}).drop("_q", "_from", "_to", "_hash")
        new = stored(e.where("NOT right").unionByName(late.where("a <> b")).drop("q", "right"), "edge-blocks")
        dropped(e, found)
        e = new
    ways = stored(e.groupBy("block").applyInPandas(_walk, _WAY), "label-ways")
    for _ in range(levels):  # a way goes on in another stretch; each round doubles how many it has passed
        more = ways.select(F.col("customer_id").alias("_c"), F.col("way").alias("_more"))
        longer = ways.join(more, F.element_at("way", -1)["label"] == F.col("_c"), "left")
        new = stored(longer.select("customer_id", F.concat("way", F.coalesce("_more", F.expr("array()"))).alias("way")), "label-ways")
        dropped(ways)
        ways = new
    return ways


def _relabelled(events: DataFrame, ways: DataFrame) -> DataFrame:
    """``events`` (customer_id, ts_sec, kind, order_id, sub) once for each label that their customer bears from then on.

    To the label of their own time they come at their place; to a later one ahead of the order that brings it. ``t`` is
    the time at which they happened, ``live`` tells whether they come at their place.
    """
    e = events.join(ways, "customer_id", "left")
    place = lambda x: F.struct(x["ts_sec"], F.lit(1), x["order_id"])
    own = F.struct("ts_sec", "kind", "order_id")
    first = F.struct(F.col("customer_id").alias("label"), F.lit(None).cast("long").alias("ts_sec"), F.lit(None).cast("long").alias("order_id"))
    e = e.withColumn("way", F.concat(F.array(first), F.coalesce("way", F.expr("array()"))))
    # A label counts if the next one holds from later on than the event.
    after = lambda i: F.get("way", i + 1)
    e = e.withColumn("as", F.explode(F.filter("way", lambda x, i: after(i).isNull() | (own < place(after(i))))))
    live = F.col("as.ts_sec").isNull() | (own >= place(F.col("as")))
    e = e.withColumns({"t": F.col("ts_sec"), "live": live}).withColumn("comp", F.col("as.label"))
    return e.withColumns({
        "ts_sec": F.when(F.col("live"), F.col("ts_sec")).otherwise(F.col("as.ts_sec")), "kind": F.when(F.col("live"), F.col("kind")).otherwise(1),
        "order_id": F.when(F.col("live"), F.col("order_id")).otherwise(F.col("as.order_id")), "sub": F.when(F.col("live"), F.col("sub")).otherwise(AHEAD),
    }).drop("way", "as", "customer_id")


def component_features(orders: DataFrame, returns: DataFrame, customers: DataFrame, edges: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """As-of component of each order and its statistics; no component, however large, passes one task."""
    ways = label_ways(edges, stretch)
    signup = customers.select("customer_id", seconds("signup_ts").cast("double").alias("_signup"))
    at = lambda kind, sub: (F.lit(kind).alias("kind"), F.lit(sub).alias("sub"))
    placed = orders.select("customer_id", "ts_sec", "order_id", *at(1, SELF), F.lit(1).alias("n"), "cod", "value_inr", "device_id", "cluster")
    back = latest_returns(returns).join(orders.select("order_id", "customer_id"), "order_id").select("customer_id", seconds("return_ts").alias("ts_sec"), "order_id", *at(0, SELF), F.lit(1).alias("ret"))
    # A customer is a member from the first order on, ahead of it; one without a signup is as old as that order.
    member = first_uses(orders, ["customer_id"], []).join(signup, "customer_id", "left")
    member = member.select("customer_id", "ts_sec", "order_id", *at(1, AHEAD), F.lit(1).alias("member"), F.coalesce("_signup", F.col("ts_sec").cast("double")).alias("signup"))
    merged = ways.select("customer_id", F.get("way", F.lit(0)).alias("m")).select("customer_id", "m.ts_sec", "m.order_id", *at(1, AHEAD), F.lit(1).alias("merge"))
    every = placed
    for part in (back, member, merged):
        every = every.unionByName(part, allowMissingColumns=True)
    rows = stored(_relabelled(every, ways), "component-events")
    dropped(ways)
    scan = rows.drop("device_id", "cluster")
    for item, name in (("device_id", "device"), ("cluster", "door")):
        place = F.struct("ts_sec", "kind", "order_id", F.when(F.col("live"), AFTER).otherwise(AHEAD).alias("sub"))
        first = rows.where("n = 1").groupBy("comp", item).agg(F.min(place).alias("at"))
        scan = scan.unionByName(first.select("comp", "at.ts_sec", "at.kind", "at.order_id", "at.sub", F.lit(1).alias(name)), allowMissingColumns=True)
    own = "cast(coalesce(n, 0) AS double)"
    got = prefix(scan, ["comp"], ["ts_sec", "kind", "order_id", "sub"], Prefix(
        sums={"_size": "member", "_n": "n", "_ret": "ret", "_cod": "cod", "_sum": "value_inr", "_signup": "signup", "_dev": "device", "_door": "door"}, least={"_oldest": "signup"},
        fades={"comp_orders_d7": (own, "t", TAU7), "comp_orders_d30": (own, "t", TAU30), "comp_growth_d7": ("cast(coalesce(merge, 0) AS double)", "t", TAU7)},
    ), "components", f"n = 1 AND live AND sub = {SELF}")
    dropped(rows)  # the scan has its own table
    c = F.col
    zero: Column = F.lit(0.0)
    mean = F.greatest(c("ts_sec") - c("_signup") / c("_size"), zero) / DAY
    return got.select(
        "order_id", c("_size").alias("comp_size"), c("_n").alias("comp_prior_orders"), ((c("_ret") + 1) / (c("_n") + 8)).alias("comp_return_rate"),
        ((c("_cod") + 1) / (c("_n") + 2)).alias("comp_cod_share"), "comp_orders_d7", "comp_orders_d30", "comp_growth_d7", mean.alias("comp_mean_tenure_days"),
        (F.greatest(c("ts_sec") - c("_oldest"), zero) / DAY).alias("comp_max_tenure_days"), c("_dev").alias("comp_distinct_devices"), c("_door").alias("comp_distinct_addr_clusters"),
        (c("_sum") / c("_size")).alias("comp_value_per_customer"), (c("_n") / c("_size")).alias("comp_orders_per_customer"),
        (c("_n") / (c("_size") * F.greatest(mean, F.lit(1.0)))).alias("comp_orders_per_member_per_day"),
    )
