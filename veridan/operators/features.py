"""All features of an order, one row an order, and the proof that none reads the future."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import intrinsic, safe_ratio, seconds, with_address_cluster
from ..sources.tables import guard
from . import asof, graph
from .tables import dropped, passing, stored

#: Running totals that grow with the age of the data, and the rates that stand in for them.
RUNNING_TOTALS = [
    "cust_prior_orders", "cust_prior_cod", "cust_prior_returns", "cust_mean_value", "cust_max_value", "dev_prior_orders", "dev_age_days",
    "addr_prior_orders", "addr_variant_count", "pin_prior_orders", "pin_distinct_customers", "comp_prior_orders", "comp_value_per_customer",
    "comp_orders_per_customer",
]
RATES = [
    "cust_orders_per_day", "dev_orders_per_day", "addr_orders_per_day", "comp_orders_per_member_per_day", "addr_age_days", "pin_orders_share",
    "pin_cust_share", "comp_orders_share",
]
CATEGORIES = ["apparel", "footwear", "electronics", "beauty", "grocery"]


def feature_set(columns: list[str], name: str) -> list[str]:
    """``all``, ``stable`` (no running totals) or ``plain`` (no rates)."""
    drop = {"all": [], "stable": RUNNING_TOTALS, "plain": RATES}[name]
    return [c for c in columns if c not in drop]


def clusters(addresses: DataFrame) -> DataFrame:
    return with_address_cluster(addresses.select("address_id", "raw_line", "pincode")).drop("raw_line")


KINDS = ("orders", "customers", "addresses", "phones", "returns")
#: A further part: of resolved orders and their events to order_id and columns.
Part = Callable[[DataFrame, DataFrame], DataFrame]


def build_features(
    orders: DataFrame, customers: DataFrame, addresses: DataFrame, phones: DataFrame, returns: DataFrame, categories: list[str] = CATEGORIES, extra: tuple[Part, ...] = ()
) -> DataFrame:
    """order_id and its features. Inputs may hold placement-time columns only.

    Each key's features come from one scan over that key's events; the parts meet in one shuffle by order_id. ``extra``: further parts.
    """
    tables = {"orders": orders, "customers": customers, "addresses": addresses, "phones": phones, "returns": returns}
    for name, df in tables.items():
        guard(name, df)
    return _built(tables, categories, extra)


def _built(t: dict[str, DataFrame], categories: list[str], extra: tuple[Part, ...], scope: list[str] | None = None, key: Column | None = None) -> DataFrame:
    o = graph.stored(asof.resolved(t["orders"], clusters(t["addresses"])), "resolved")
    back = stored(asof.latest_returns(t["returns"]), "returns")  # two parts read it
    e = graph.stored(asof.event_stream(o, back), "events")
    flags = intrinsic(categories)
    out = asof.together([
        lambda: graph.component_features(o, back, t["customers"], graph.stored(graph.identity_edges(o, t["phones"]), "edges")),
        lambda: asof.customer_part(e, o), lambda: asof.phone_part(o, t["phones"]), lambda: asof.device_part(e, o), lambda: asof.cluster_part(e, o), lambda: asof.pincode_part(e, o),
        lambda: asof.asof_category(e, scope), lambda: asof.asof_global(o, scope), lambda: asof.tenure(o, t["customers"]),
        lambda: o.select("order_id", "value_inr", "item_count", "promo_used", *[c.alias(n) for n, c in flags.items()]), *[lambda part=p: part(o, e) for p in extra],
    ], key)
    if not extra:  # all scans are written; further parts may read the events later
        dropped(e, back)
    out = asof.asof_rates(out).withColumn("comp_orders_share", safe_ratio(F.col("comp_prior_orders"), F.col("global_orders")))
    return out.drop("global_orders", "global_customers")


def prefix_truncate(tables: dict[str, DataFrame], cut) -> dict[str, DataFrame]:
    """The world before ``cut``: its orders, their returns before it, and the entities they use."""
    o = tables["orders"].where(F.col("order_ts") < cut)
    return {
        "orders": o,
        "returns": tables["returns"].where(F.col("return_ts") < cut).join(o.select("order_id"), "order_id", "left_semi"),
        "customers": tables["customers"].join(o.select("customer_id"), "customer_id", "left_semi"),
        "addresses": tables["addresses"].join(o.select("address_id"), "address_id", "left_semi"),
        "phones": tables["phones"].join(o.select("phone_id"), "phone_id", "left_semi"),
    }


def _compared(pairs: DataFrame, columns: dict[str, tuple[Column, Column]], by: list[str], tolerance: float) -> DataFrame:
    """``by``, _n (rows) and an array ``of`` (feature, rows_differing, max_abs_delta) over ``columns``: a name to the two doubles compared.

    Nulls equal nulls. All columns are summed in one pass over the rows, which are not multiplied by them.
    """
    sums = []
    for i, (x, y) in enumerate(columns.values()):
        same = F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x)), x.isNull() & y.isNull())
        sums += [F.sum((~same).cast("long")).alias(f"_d{i}"), F.max(F.abs(x - y)).alias(f"_m{i}")]
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_d{i}").alias("rows_differing"), F.col(f"_m{i}").alias("max_abs_delta")) for i, c in enumerate(columns)])
    return pairs.groupBy(*by).agg(F.count("*").alias("_n"), *sums).where("_n > 0").select(*by, "_n", each.alias("of"))


def feature_diff(full: DataFrame, cut: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """feature, rows_differing, max_abs_delta over the orders of ``cut``, most first.

    ``tolerance``: how much values may differ, relative to values above 1 (sums of doubles round by their order).
    """
    cols = [c for c in cut.columns if c != "order_id"]
    both = cut.join(full.select("order_id", *[F.col(c).alias(f"_f_{c}") for c in cols]), "order_id", "left")
    pairs = {c: (F.col(c).cast("double"), F.col(f"_f_{c}").cast("double")) for c in cols}
    return _compared(both, pairs, [], tolerance).selectExpr("inline(of)").orderBy(F.desc("rows_differing"), "feature")


#: What parts the phone numbers of two worlds: more than any number has digits.
_FAR = 10**15


def _worlds(tables: dict[str, DataFrame], cuts: list[Column]) -> dict[str, DataFrame]:
    """The whole world (0) and the world before each cut (1, 2, ...) as one, each id with its world's number in it.

    An id becomes id * worlds + world, so ids keep their order in a world and no two worlds share a key.
    """
    k = len(cuts) + 1

    def own(w: int, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        mine = lambda df, *ids: df.withColumns({i: F.col(i) * k + w for i in ids if i in df.columns})
        return {
            "orders": mine(t["orders"], "order_id", "customer_id", "device_id", "address_id", "phone_id").withColumn("world", F.lit(w)), "customers": mine(t["customers"], "customer_id"),
            "addresses": mine(t["addresses"], "address_id").withColumn("pincode", F.col("pincode").cast("long") * k + w),
            "phones": mine(t["phones"], "phone_id").withColumn("msisdn", (F.col("msisdn").cast("long") + w * _FAR).cast("string")), "returns": mine(t["returns"], "order_id"),
        }

    every = [own(0, tables), *[own(w + 1, prefix_truncate(tables, cut)) for w, cut in enumerate(cuts)]]
    return {name: reduce(DataFrame.unionByName, [w[name] for w in every]) for name in KINDS}


def world_features(tables: dict[str, DataFrame], cuts: list[Column], categories: list[str] = CATEGORIES, extra: tuple[Part, ...] = ()) -> DataFrame:
    """_key (the order's own id), order_id (in its world), world and the features of each order in each world that has it, from one
    build, dealt by _key."""
    k = len(cuts) + 1
    out = _built(_worlds(tables, cuts), categories, extra, ["world"], F.expr(f"order_id div {k}"))
    return out.withColumn("world", (F.col("order_id") % k).cast("int"))


def gate_table(tables: dict[str, DataFrame], cuts: list[Column], tolerance: float = 1e-9, **parameters) -> DataFrame:
    """cut (its number, from 1), feature, rows_differing, max_abs_delta of each cut world against the whole one.

    All worlds come from one build, and an order meets itself in the other worlds in the shuffle that puts its parts together, so k cuts
    cost one pass and no further shuffle, sort or table of features. A cut before all orders has no rows. ValueError where a world lacks
    orders of its own.
    """
    for name in KINDS:
        guard(name, tables[name])
    with passing(tables["orders"].sparkSession) as keep:
        # Every world reads these.
        every = {k: stored(tables[k], f"gate-{k}") if k in ("orders", "customers", "returns") else tables[k] for k in KINDS}
        f = world_features(every, cuts, **parameters)
        cols = [c for c in f.columns if c not in ("_key", "order_id", "world")]
        f = f.select("_key", "order_id", "world", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
        # The whole world's order comes first.
        first = Window.partitionBy("_key").orderBy("order_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = f.withColumns({"y": F.first("x").over(first), "whole": F.first("world").over(first)}).where("whole = 0")
        diff = keep(stored(_compared(pairs, {c: (F.get("x", F.lit(i)), F.get("y", F.lit(i))) for i, c in enumerate(cols)}, ["world"], tolerance), "gate-worlds"))
        want = every["orders"].agg(F.count("*"), *[F.count(F.when(F.col("order_ts") < c, 1)) for c in cuts]).first()
    n = {r[0]: r[1] for r in diff.select("world", "_n").collect()}  # a row a world
    if any(n.get(w, 0) != m for w, m in enumerate(want)):
        raise ValueError(f"{n} rows for {list(want)} orders")
    return diff.where("world > 0").selectExpr("world AS cut", "inline(of)")


def causality_gate(tables: dict[str, DataFrame], cuts: Column | list[Column], tolerance: float = 1e-9, **parameters) -> DataFrame:
    """The rows of :func:`gate_table`; ValueError names each cut and feature whose values before the cut depend on what comes after."""
    diff = gate_table(tables, cuts if isinstance(cuts, list) else [cuts], tolerance, **parameters)
    diff = graph.stored(diff.withColumn("max_abs_delta", F.coalesce("max_abs_delta", F.lit(0.0))), "gate-diff")
    bad = [(r["cut"], r["feature"]) for r in diff.where("rows_differing > 0").orderBy("cut", "feature").collect()]  # a row a cut and feature
    if bad:
        raise ValueError(f"features that read the future: {bad}")
    return diff
