"""Point-in-time aggregates: for each order only what came before it.

Orders of one second follow each other by order_id; a return counts from its own second on, before that
second's orders. All features of a key (customer, device, address cluster, phone number, pincode, category, the whole
marketplace) come from one prefix scan over the key's events (``operators.scan``), which splits any key by its rows.
Distinct counts are sums of first occurrences, which are minima by (key, item): rows of their own in the key's
stream, beside the order that they belong to, so neither a set nor a window over a pair of keys is needed.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, safe_ratio, seconds, smoothed_rate
from .scan import Prefix, prefix

TAU7, TAU30 = 7 * DAY, 30 * DAY
#: Rows of a key's bucket beyond which it is cut further.
BUCKET_ROWS = 1_000_000
_ORDER = ["ts_sec", "kind", "order_id"]


def prior(key: list[str] | str, order: list[str] = _ORDER) -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def latest_returns(returns: DataFrame) -> DataFrame:
    """One return an order: the latest."""
    return returns.groupBy("order_id").agg(F.max("return_ts").alias("return_ts"))


def timed(orders: DataFrame) -> DataFrame:
    """Orders with ts_sec and cod."""
    return orders.withColumn("ts_sec", seconds("order_ts")).withColumn("cod", (F.col("payment_mode") == "COD").cast("int"))


def resolved(orders: DataFrame, clusters: DataFrame) -> DataFrame:
    """Orders with ts_sec, cod, and the cluster and pincode of their address."""
    return timed(orders).join(clusters.select("address_id", "cluster", "pincode"), "address_id", "left")


def event_stream(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Order rows (kind 1) and the returns of known orders (kind 0), which carry their order's ids."""
    keys = [c for c in ("customer_id", "device_id", "address_id", "phone_id", "category", "value_inr", "cod", "cluster", "pincode", "world") if c in orders.columns]
    placed = orders.select("order_id", "ts_sec", F.lit(1).alias("kind"), *keys)
    back = latest_returns(returns).join(orders.select("order_id", *keys), "order_id")
    return placed.unionByName(back.select("order_id", seconds("return_ts").alias("ts_sec"), F.lit(0).alias("kind"), *keys))


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def running(events: DataFrame, key: str, sums: dict[str, Column | str], firsts: bool = False) -> DataFrame:
    """Order rows with running sums over the key's earlier events; ``first_ts`` of its earlier orders."""
    w = prior(key)
    out = events.withColumns({n: _zero(F.sum(_column(c)).over(w)) for n, c in sums.items()})
    if firsts:
        out = out.withColumn("first_ts", F.min(F.when(F.col("kind") == 1, F.col("ts_sec"))).over(w))
    return out.where("kind = 1")


def running_two_level(events: DataFrame, key: list[str], sums: dict[str, Column | str], bucket: float = DAY, most: int = BUCKET_ROWS) -> DataFrame:
    """Like ``running``, for keys that hold a large share of the rows; an empty key is the whole table.

    Buckets are ``bucket`` wide; one of more than ``most`` rows is cut into as many equal parts as it holds ``most``.
    """
    e = events.withColumn("_d", F.floor(F.col("ts_sec") / bucket))
    full = e.groupBy(*key, "_d").count().where(F.col("count") > most)
    full = full.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_d").alias("_fd"), F.ceil(F.col("count") / most).cast("double").alias("_f"))
    same = F.col("_d") == F.col("_fd")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    e = e.join(full, same, "left")
    part = F.floor((F.col("ts_sec") / bucket - F.col("_d")) * F.col("_f")) / F.col("_f")
    e = e.withColumn("_b", F.col("_d") + F.coalesce(part, F.lit(0.0))).drop("_d", "_fd", "_f", *[f"_k_{k}" for k in key])
    e = e.withColumns({f"_v_{n}": _column(c) for n, c in sums.items()})
    totals = e.groupBy(*key, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*(key or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, "_b", *[_zero(F.sum(f"_t_{n}").over(before)).alias(f"_o_{n}") for n in sums])
    inside = prior([*key, "_b"])
    out = e.withColumns({f"_i_{n}": _zero(F.sum(f"_v_{n}").over(inside)) for n in sums}).where("kind = 1")
    offsets = offsets.select(F.col("_b").alias("_ob"), *[F.col(k).alias(f"_k_{k}") for k in key], *[f"_o_{n}" for n in sums])
    same = F.col("_b") == F.col("_ob")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(offsets, same).drop("_ob", *[f"_k_{k}" for k in key])
    return out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_i_{n}") for n in sums}).drop("_b", *[f"_{x}_{n}" for x in "vio" for n in sums])


def exact_quantiles(rows: DataFrame, value: str, probs: list[float], by: list[str] | None = None, width: float = DAY) -> DataFrame:
    """``by`` and q: the exact quantiles of ``value`` with straight lines between ranks, one array a group; nulls don't count.

    Equal values are counted first and ranked by two-level running counts (buckets of ``width``), so no buffer holds a
    group's values. A group without values has no row.
    """
    by = by or []
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("ts_sec")).agg(F.count("*").alias("_n"))
    n = n.withColumns({"kind": F.lit(1), "order_id": F.lit(0)})
    ranked = running_two_level(n, by, {"_before": F.col("_n")}, bucket=width)
    total = n.groupBy(*[F.col(k).alias(f"_t_{k}") for k in by]).agg(F.sum("_n").alias("_total"))
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    # The places that a quantile needs, as many rows as values hold one of them: few.
    wanted = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p, i: F.struct(i.alias("i"), (p * (F.col("_total") - 1)).alias("at")))
    held = ranked.join(total, same).withColumn("_end", F.col("_before") + F.col("_n"))
    inside = lambda x: (x >= F.col("_before")) & (x < F.col("_end"))
    held = held.withColumn("w", F.explode(F.filter(wanted, lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))))
    at = F.col("w.at")
    each = held.groupBy(*by, F.col("w.i").alias("i")).agg(
        F.max(at).alias("at"), F.max(F.when(inside(F.floor(at)), F.col("ts_sec"))).alias("lo"), F.max(F.when(inside(F.ceil(at)), F.col("ts_sec"))).alias("hi")
    )
    up = F.col("at") - F.floor("at")
    each = each.withColumn("v", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - up) * F.col("lo") + up * F.col("hi")))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))


_IS_ORDER, _IS_RETURN = "if(kind = 1, 1, 0)", "if(kind = 0, 1, 0)"
#: Place of a row within its event: ahead of the order itself, the order, after it.
AHEAD, SELF, AFTER = 0, 1, 2
_PLACES = ["ts_sec", "kind", "order_id", "sub"]
_SELF = f"kind = 1 AND sub = {SELF}"


def first_uses(orders: DataFrame, key: list[str], item: list[str]) -> DataFrame:
    """(key, item, ts_sec, order_id): the first order of each item with each key. A minimum, so no pair passes one task."""
    n = orders.groupBy(*key, *item).agg(F.min(F.struct("ts_sec", "order_id")).alias("_at"))
    return n.select(*key, *item, "_at.ts_sec", "_at.order_id")


def with_firsts(events: DataFrame, orders: DataFrame, key: str, firsts: dict[str, tuple[str, int]]) -> DataFrame:
    """``events`` and a row for each first occurrence of an item in the orders of ``key``.

    ``firsts``: name of a column that is 1 in these rows, to (item, place): AHEAD counts the order's own item, AFTER doesn't.
    """
    out = events.withColumn("sub", F.lit(SELF))
    for name, (item, place) in firsts.items():
        own = first_uses(orders, [key], [item])
        out = out.unionByName(own.select(key, "ts_sec", "order_id", F.lit(1).alias("kind"), F.lit(place).alias("sub"), F.lit(1).alias(name)), allowMissingColumns=True)
    return out


def _scan(rows: DataFrame, key: list[str], what: Prefix, name: str) -> DataFrame:
    return prefix(rows, key, _PLACES, what, f"asof-{name}", _SELF)


def _only_orders(orders: DataFrame) -> DataFrame:
    return orders.withColumn("kind", F.lit(1))


_VALUE = "if(kind = 1 AND sub = 1, value_inr, null)"
_ORDERS = {"_n": f"if({_SELF}, 1, 0)"}
_RETURNS = {"_r": _IS_RETURN}


def customer_part(events: DataFrame, orders: DataFrame) -> DataFrame:
    """All features of the customer's own past, from one scan."""
    e = events.select("order_id", "ts_sec", "kind", "customer_id", "cod", "value_inr")
    e = with_firsts(e, orders, "customer_id", {"_device": ("device_id", AFTER), "_cluster": ("cluster", AFTER)})
    own = f"if({_SELF}, 1D, 0D)"
    got = _scan(e, ["customer_id"], Prefix(
        sums=_ORDERS | _RETURNS | {"_c": f"if({_SELF}, cod, 0)", "_s": _VALUE, "_dd": "_device", "_dc": "_cluster"}, most={"_max": _VALUE, "_last": f"if({_SELF}, ts_sec, null)"},
        fades={"cust_orders_d7": (own, "ts_sec", TAU7), "cust_orders_d30": (own, "ts_sec", TAU30)}, moments={("_vn", "_vm", "_v2"): _VALUE},
    ), "customer")
    n = F.col("_n")
    mean, sd = F.when(n > 0, F.col("_s") / n).otherwise(0.0), F.sqrt(F.col("_v2") / (F.col("_vn") - 1))
    return got.select(
        "order_id", n.alias("cust_prior_orders"), F.col("_c").alias("cust_prior_cod"), ((F.col("_c") + 1) / (n + 2)).alias("cust_cod_share"),
        F.col("_r").alias("cust_prior_returns"), smoothed_rate(F.col("_r"), n).alias("cust_return_rate"),
        F.coalesce((F.col("ts_sec") - F.col("_last")) / DAY, F.lit(999.0)).alias("cust_days_since_last"), "cust_orders_d7", "cust_orders_d30", mean.alias("cust_mean_value"),
        F.when((F.col("_vn") > 1) & (sd > 1e-6), (F.col("value_inr") - mean) / sd).otherwise(0.0).alias("cust_value_z"), F.coalesce("_max", F.lit(0.0)).alias("cust_max_value"),
        F.col("_dd").alias("cust_distinct_devices"), F.col("_dc").alias("cust_distinct_addr_clusters"),
    )


def _age() -> Column:
    return F.coalesce((F.col("ts_sec") - F.col("_first")) / DAY, F.lit(0.0))


_FIRST = {"_first": f"if({_SELF}, ts_sec, null)"}


def device_part(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Other customers, orders, return rate and age of the device."""
    e = with_firsts(events.select("order_id", "ts_sec", "kind", "device_id"), orders, "device_id", {"_customer": ("customer_id", AHEAD)})
    got = _scan(e, ["device_id"], Prefix(sums=_ORDERS | _RETURNS | {"_u": "_customer"}, least=_FIRST), "device")
    return got.select(
        "order_id", (F.col("_u") - 1).alias("dev_distinct_customers"), F.col("_n").alias("dev_prior_orders"), smoothed_rate(F.col("_r"), F.col("_n")).alias("dev_return_rate"), _age().alias("dev_age_days")
    )


def cluster_part(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Other customers, orders, return rate and age of the door, its spellings, and whether this one is new to a known door."""
    e = with_firsts(
        events.select("order_id", "ts_sec", "kind", "cluster"), orders, "cluster",
        {"_customer": ("customer_id", AHEAD), "_known": ("address_id", AFTER), "_spelled": ("address_id", AHEAD)},
    )
    got = _scan(e, ["cluster"], Prefix(sums=_ORDERS | _RETURNS | {"_u": "_customer", "_a": "_known", "_b": "_spelled"}, least=_FIRST), "cluster")
    return got.select(
        "order_id", (F.col("_u") - 1).alias("addr_distinct_customers"), F.col("_n").alias("addr_prior_orders"), smoothed_rate(F.col("_r"), F.col("_n")).alias("addr_return_rate"),
        F.col("_a").alias("addr_variant_count"), ((F.col("_b") > F.col("_a")) & (F.col("_n") > 0)).cast("int").alias("addr_is_new_variant_of_known_cluster"), _age().alias("addr_age_days"),
    )


def pincode_part(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Earlier orders, distinct earlier customers and return rate of the pincode."""
    e = with_firsts(events.select("order_id", "ts_sec", "kind", "pincode"), orders, "pincode", {"_customer": ("customer_id", AFTER)})
    got = _scan(e, ["pincode"], Prefix(sums=_ORDERS | _RETURNS | {"_u": "_customer"}), "pincode")
    return got.select("order_id", F.col("_u").alias("pin_distinct_customers"), F.col("_n").alias("pin_prior_orders"), smoothed_rate(F.col("_r"), F.col("_n")).alias("pin_return_rate"))


def asof_customer(orders: DataFrame) -> DataFrame:
    """Earlier orders of the customer: count, COD count, mean, maximum, z-score of this value, days since the last."""
    out = customer_part(_only_orders(orders), orders)
    return out.select("order_id", "cust_prior_orders", "cust_prior_cod", "cust_cod_share", "cust_days_since_last", "cust_mean_value", "cust_value_z", "cust_max_value")


def asof_decayed_counts(orders: DataFrame) -> DataFrame:
    """Earlier orders of the customer, each fading with 7 and 30 days; any span of history."""
    return customer_part(_only_orders(orders), orders).select("order_id", "cust_orders_d7", "cust_orders_d30")


def asof_distinct(orders: DataFrame) -> DataFrame:
    """Running distinct devices and clusters of the customer; other customers of device and cluster; spellings."""
    e = _only_orders(orders)
    return together([
        lambda: customer_part(e, orders).select("order_id", "cust_distinct_devices", "cust_distinct_addr_clusters"),
        lambda: device_part(e, orders).select("order_id", "dev_distinct_customers"),
        lambda: cluster_part(e, orders).select("order_id", "addr_distinct_customers", "addr_variant_count"),
    ])


def asof_return_rates(events: DataFrame) -> DataFrame:
    """Smoothed return rates of customer, device, cluster, pincode and category as known at each order."""

    def part(key: str, name: str) -> DataFrame:
        e = events.select("order_id", "ts_sec", "kind", key).withColumn("sub", F.lit(SELF))
        p = _scan(e, [key], Prefix(sums=_ORDERS | _RETURNS), name)
        rate = smoothed_rate(F.col("_r"), F.col("_n")).alias(f"{name}_return_rate" + ("_prior" if name == "cat" else ""))
        return p.select("order_id", rate, *([F.col("_r").alias("cust_prior_returns")] if name == "cust" else []))

    keys = (("customer_id", "cust"), ("device_id", "dev"), ("cluster", "addr"), ("pincode", "pin"), ("category", "cat"))
    return together([lambda k=k, n=n: part(k, n) for k, n in keys])


def asof_entity(orders: DataFrame, key: str, prefix: str) -> DataFrame:
    """Earlier orders of a device or cluster, and its age in days (0 when new)."""
    e = _only_orders(orders).select("order_id", "ts_sec", "kind", key).withColumn("sub", F.lit(SELF))
    return _scan(e, [key], Prefix(sums=_ORDERS, least=_FIRST), prefix).select("order_id", F.col("_n").alias(f"{prefix}_prior_orders"), _age().alias(f"{prefix}_age_days"))


def asof_address(orders: DataFrame) -> DataFrame:
    """``asof_entity`` of the cluster, and whether a known cluster is spelled by an address not seen in it."""
    return cluster_part(_only_orders(orders), orders).select("order_id", "addr_prior_orders", "addr_age_days", "addr_is_new_variant_of_known_cluster")


def asof_pincode(orders: DataFrame) -> DataFrame:
    """Earlier orders and distinct earlier customers of the pincode."""
    return pincode_part(_only_orders(orders), orders).select("order_id", "pin_prior_orders", "pin_distinct_customers")


def together(makers: list[Callable[[], DataFrame]], key: Column | None = None) -> DataFrame:
    """One row an order with the columns of all parts, which have a row for each order at most.

    The parts write their tables at the same time, as none waits for another. Their values go packed, each in an array of
    its part, through one shuffle by order_id; there is no join. The result is dealt by ``key``, a function of
    order_id (itself if none is given), so a join on it or a table in buckets by it needs no further shuffle.
    """
    with ThreadPoolExecutor(len(makers)) as pool:
        parts = [f.result() for f in [pool.submit(contextvars.copy_context().run, m) for m in makers]]
    every, kinds = None, []
    for i, p in enumerate(parts):
        own = [(c, t) for c, t in p.dtypes if c != "order_id"]
        kinds.append(own)
        row = p.select("order_id", F.array(*[F.col(c).cast("double") for c, _ in own]).alias(f"_p{i}"))
        every = row if every is None else every.unionByName(row, allowMissingColumns=True)
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = every.withColumn("_key", F.col("order_id") if key is None else key)
    g = every.repartition(n, "_key").groupBy("_key", "order_id").agg(*[F.first(f"_p{i}", ignorenulls=True).alias(f"_p{i}") for i in range(len(parts))])
    # Without a key of its own order_id is that by which the rows were dealt, so what follows by order_id needs no shuffle.
    ids = [F.col("_key").alias("order_id")] if key is None else ["order_id", "_key"]
    return g.select(*ids, *[F.col(f"_p{i}")[j].cast(t).alias(c) for i, own in enumerate(kinds) for j, (c, t) in enumerate(own)])


def phone_numbers(phones: DataFrame) -> DataFrame:
    """(phone_id, num, several): the number of each phone, and whether other phones have it too. Phones without a number are absent."""
    n = phones.select("phone_id", F.col("msisdn").cast("long").alias("num")).where("num IS NOT NULL").distinct()
    many = n.groupBy(F.col("num").alias("_m")).agg((F.count("*") > 1).alias("several"))
    return n.join(many, F.col("num") == F.col("_m")).drop("_m")


def near_numbers(numbers: DataFrame, window: int = 5) -> DataFrame:
    """(num, near): other numbers that some phone has and that differ by ``window`` at most: 2 * window for each at most."""
    n = numbers.select("num").distinct()
    near = n.select("num", F.explode(F.expr(f"filter(sequence(num - {window}, num + {window}), x -> x <> num)")).alias("near"))
    return near.join(n.select(F.col("num").alias("_n")), F.col("near") == F.col("_n"), "left_semi")


def phone_neighbours(phones: DataFrame, window: int = 5) -> DataFrame:
    """(phone_id, neighbour_id): other phones whose number differs by ``window`` at most. As many rows as there are pairs."""
    n = phone_numbers(phones)
    other = n.select(F.col("phone_id").alias("neighbour_id"), F.col("num").alias("_n"))
    near = n.join(near_numbers(n, window), "num").join(other, F.col("near") == F.col("_n")).select("phone_id", "neighbour_id")
    same = n.where("several").join(other, F.col("num") == F.col("_n")).where("phone_id <> neighbour_id").select("phone_id", "neighbour_id")
    return near.unionByName(same)


def phone_part(orders: DataFrame, phones: DataFrame, window: int = 5) -> DataFrame:
    """Earlier orders on adjacent phones, and their customers, counted once for each phone.

    Phones meet by number: an order is seen by the numbers near its own, of which there are few, however many phones share
    one. A number that several phones have sees its own orders too, less those of the order's own phone.
    """
    n = phone_numbers(phones)
    o = orders.select("order_id", "ts_sec", "phone_id", "customer_id").join(n, "phone_id")
    new = first_uses(o, ["phone_id", "num", "several"], ["customer_id"])
    seen = o.select("ts_sec", "order_id", "num", "several", "phone_id", F.lit(1).alias("_o"), F.lit(0).alias("_new"))
    seen = seen.unionByName(new.select("ts_sec", "order_id", "num", "several", "phone_id", F.lit(0).alias("_o"), F.lit(1).alias("_new")))
    far = seen.join(near_numbers(n, window), "num").select("ts_sec", "order_id", "_o", "_new", F.lit(AFTER).alias("sub"), F.lit(0).alias("of"), F.col("near").alias("id"))
    # of: 0 a number, 1 a phone of a number that several have.
    same = seen.where("several").select("ts_sec", "order_id", "_o", "_new", F.lit(AFTER).alias("sub"), F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("num").alias("id")), F.struct(F.lit(1).alias("of"), F.col("phone_id").alias("id")))).alias("k"))
    same = same.select("ts_sec", "order_id", "_o", "_new", "sub", "k.of", "k.id")
    ask = o.select("ts_sec", "order_id", F.lit(0).alias("_o"), F.lit(0).alias("_new"), F.lit(SELF).alias("sub"), F.explode(F.filter(F.array(F.struct(F.lit(0).alias("of"), F.col("num").alias("id")), F.when(F.col("several"), F.struct(F.lit(1).alias("of"), F.col("phone_id").alias("id")))), lambda x: x.isNotNull())).alias("k"))
    ask = ask.select("ts_sec", "order_id", "_o", "_new", "sub", "k.of", "k.id")
    # The number's row of an order and those of its first use share their place: a number tells them apart.
    rows = far.unionByName(same).unionByName(ask).withColumns({"kind": F.lit(1), "tie": F.col("_new")})
    got = prefix(rows, ["of", "id"], [*_PLACES, "tie"], Prefix(sums={"_a": "_new", "_b": "_o"}), "asof-phones", f"sub = {SELF}")
    # Orders on phones without a number see nothing; each other order has one row, or two.
    sign = F.when(F.col("of") == 0, 1).otherwise(-1)
    rest = orders.join(n, "phone_id", "left_anti").select("order_id", F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), F.lit(0).alias("of"))
    every = got.select("order_id", "_a", "_b", "of").unionByName(rest)
    return every.groupBy("order_id").agg(F.sum(F.col("_a") * sign).alias("phone_neighbours_active"), F.sum(F.col("_b") * sign).alias("phone_neighbour_orders"))


asof_phone_neighbours = phone_part


def asof_category(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Return rate of the category, and this value over its running mean (1 without one). ``scope``: columns that part worlds."""
    key = [*(scope or []), "category"]
    e = events.select("order_id", "ts_sec", "kind", *key, "value_inr").withColumn("sub", F.lit(SELF))
    e = _scan(e, key, Prefix(sums=_ORDERS | _RETURNS | {"_s": _VALUE}), "category")
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    return e.select(
        "order_id", smoothed_rate(F.col("_r"), F.col("_n")).alias("cat_return_rate_prior"),
        F.when(mean > 1e-6, F.col("value_inr") / mean).otherwise(1.0).alias("value_over_cat_mean"),
    )


def asof_global(orders: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Marketplace orders before this one, and customers up to and with this one. ``scope``: columns that part worlds."""
    key = scope or []
    new = first_uses(orders, key, ["customer_id"]).select(*key, "ts_sec", "order_id", F.lit(1).alias("_new"), F.lit(AHEAD).alias("sub"))
    o = orders.select(*key, "ts_sec", "order_id", F.lit(0).alias("_new"), F.lit(SELF).alias("sub")).unionByName(new).withColumn("kind", F.lit(1))
    got = _scan(o, key, Prefix(sums=_ORDERS | {"_c": "_new"}), "global")
    return got.select("order_id", F.col("_n").alias("global_orders"), F.col("_c").alias("global_customers"))


def tenure(orders: DataFrame, customers: DataFrame) -> DataFrame:
    o = orders.join(customers.select("customer_id", seconds("signup_ts").alias("_s")), "customer_id", "left")
    return o.select("order_id", F.coalesce(F.greatest((F.col("ts_sec") - F.col("_s")) / DAY, F.lit(0.0)), F.lit(0.0)).alias("cust_tenure_days"))


def asof_rates(features: DataFrame) -> DataFrame:
    """Scale-free rates from the counts: per day of age, and shares of the marketplace."""
    c = F.col
    return features.withColumns({
        "cust_orders_per_day": safe_ratio(c("cust_prior_orders"), c("cust_tenure_days")),
        "dev_orders_per_day": safe_ratio(c("dev_prior_orders"), c("dev_age_days")),
        "addr_orders_per_day": safe_ratio(c("addr_prior_orders"), c("addr_age_days")),
        "pin_orders_share": safe_ratio(c("pin_prior_orders"), c("global_orders")),
        "pin_cust_share": safe_ratio(c("pin_distinct_customers"), c("global_customers")),
    })
