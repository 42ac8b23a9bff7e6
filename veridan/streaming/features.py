"""As-of features on a stream of orders and returns: held until the watermark passes, then folded in order of time.

Input rows: order_id, ts (event time), kind (1 order, 0 return), key, item (what is counted distinct), value, cod.
Events may arrive in any order within the lateness bound. Each waits in its key's buffer until the watermark has
passed its time; event-time timers then take the settled ones in order (ts, kind, order_id), so a return is seen by
every later order of its key, and by none before, however triggers cut the stream. Rows at or before the watermark
of the last trigger are dropped by Spark: they come later than the bound allows.

State of a key: the buffer (rows within the bound), one row of counts, sums and decayed sums, and a map with an
entry for each distinct item, of which a fold reads only its own items. An order's features leave when the watermark
passes it, so a stream that stops holds back its last rows until a later event or a heartbeat (kind 2, any key but null) comes.

Defined cases: rows without key, ts or kind and heartbeats make no output; a null item isn't counted, a null value or
cod counts as 0; repeated rows count each time; an empty stream gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "order_id long, key long, prior_orders long, prior_returns long, prior_cod long, return_rate double, days_since_last double, mean_value double, orders_d7 double, orders_d30 double, distinct_items long, age_days double"
TOTALS = "n long, ret long, cod long, items long, total double, d7 double, d30 double, first double, last double"
_EVENT = ["us", "kind", "order_id", "item", "value", "cod"]
_DAY = 86400.0
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Settle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, kind int, order_id long, item long, value double, cod int")
        self.totals = handle.getValueState("totals", TOTALS)
        self.items = handle.getMapState("items", "item long", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf[pdf["kind"].isin([0, 1]) & pdf["us"].notna()]
            if not len(pdf):
                continue
            # Whole numbers with nulls come as floats in pandas: back to integers, one by one.
            whole = [[None if x is None or x != x else int(x) for x in pdf[c]] for c in ("us", "kind", "order_id", "item")]
            self.waiting.appendList(list(zip(*whole, pdf["value"].fillna(0.0).astype(float).tolist(), pdf["cod"].fillna(0).astype(int).tolist(), strict=True)))
            self.handle.registerTimer(min(whole[0]) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        settled, rest = [], []
        for e in self.waiting.get():
            (settled if e[0] <= passed else rest).append(tuple(e))
        if not settled:  # an earlier timer of this trigger took them
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(e[0] for e in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        yield pd.DataFrame(self._fold(key[0], sorted(settled, key=lambda e: e[:3])), columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def _fold(self, key: int, events: list[tuple]) -> list[tuple]:
        n, ret, cod, items, total, d7, d30, first, last = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
        known: set[int] = set()
        out = []
        for us, kind, order, item, value, is_cod in events:
            if kind == 0:
                ret += 1
                continue
            t = us / 1e6
            gap = t - last if n else 0.0
            d7, d30 = d7 * exp(-gap / (7 * _DAY)), d30 * exp(-gap / (30 * _DAY))
            out.append((order, key, n, ret, cod, (ret + 1) / (n + 8), gap / _DAY if n else 999.0, total / n if n else 0.0, d7, d30, items, (t - first) / _DAY if n else 0.0))
            first, last = first if n else t, t
            n, cod, total, d7, d30 = n + 1, cod + is_cod, total + value, d7 + 1, d30 + 1
            if item is not None and item not in known:
                known.add(item)
                if not self.items.containsKey((item,)):
                    self.items.updateValue((item,), (us,))
                    items += 1
        self.totals.update((n, ret, cod, items, total, d7, d30, first, last))
        return out

    def close(self) -> None:
        pass


def stream_features(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Streaming frame of each order's features, for any key: customer, device, address cluster.

    Its query needs the RocksDB state store, which :func:`run_to_table` sets.
    """
    timed = events.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    return timed.where("key IS NOT NULL").select("key", "ts", *_EVENT).groupBy("key").transformWithStateInPandas(_Settle(), OUTPUT, "append", "eventTime")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over all that is there now and reads what it wrote."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
