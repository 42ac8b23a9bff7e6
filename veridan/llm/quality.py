"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad documents. A
text is compressed with each in pieces; the difference of the two compressed sizes, divided by the text's own
size, is all that the score knows. A short text says little: to every text ``FLOOR`` bytes of the average labelled
text are added. A logistic map, fitted on labelled texts that built no dictionary and weighted to the labels' own
shares, calibrates the difference to the share of good texts.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled doc_ids of each class, those with the smallest
hash of doc_id, and at most ``PIECES`` pieces of their texts for each dictionary, again by hash. Texts are cut and
compressed in tasks; every text is scored as a whole.

Defined cases: null, empty and blank texts count as the average labelled text; rows of the label
table without a 0/1 label or text, and doc_ids labelled both 0 and 1, teach nothing; of several documents of one
labelled doc_id the one whose text has the least hash teaches; with fewer than 8 good or bad documents there is no
model and ValueError is raised. A column of the input that is called like an output column is replaced; other
columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, slices, stored, trim

#: Labelled rows of each class that the model is fitted on, at most, and pieces of their texts that make one dictionary, at most.
SAMPLE, PIECES = 4000, 20_000
#: Bytes of one dictionary, of one compressed piece, those added to a text's size, and zstandard's level.
DICT_BYTES, PIECE, FLOOR, LEVEL = 110_000, 1024, 256, 3


def fold(doc_id: str = "doc_id") -> Column:
    """Remainder of crc32 of the decimal doc_id by 4; rows of remainder 2 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    average: float = 0.0  # difference a byte of the average labelled text
    intercept: float = 0.0
    slope: float = 0.0

    def _open(self) -> None:
        if not hasattr(self, "_c"):
            self._c = []
            for d in (self.good, self.bad):
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=LEVEL)
                self._c.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_dict_id=False))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def sizes(self, text: str | None) -> tuple[int, int]:
        """Compressed size with the bad dictionary less that with the good one, and own size; 0, 0 for a blank text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data.strip():
            return 0, 0
        self._open()
        good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self._c)
        return bad - good, len(data)

    def differences(self, sizes: list[tuple[int, int]] | np.ndarray) -> np.ndarray:
        x = np.array(sizes, float).reshape(-1, 2)
        return (x[:, 0] + self.average * FLOOR) / (x[:, 1] + FLOOR)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = self.differences([self.sizes(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope by Newton steps on the standardised ``x``."""
    mean = np.average(x, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, weights=weight)) + 1e-9
    z, w = np.column_stack([np.ones(len(x)), (x - mean) / scale]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of whole texts, each with a hash of its place."""
    for pdf in batches:
        for part in slices(pdf):
            rows = []
            for q, doc, text in zip(part["q"], part["doc_id"], part["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(q, xxhash.xxh3_64_intdigest(f"{doc} {i}") >> 1, data[i : i + PIECE]) for i in range(0, len(data), PIECE)]
            yield pd.DataFrame(rows, columns=["q", "x", "piece"])
        trim()


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pieces: int = PIECES) -> CompressionModel:
    """Fit on labelled rows outside the held-out fold: half of the sample makes the dictionaries, half calibrates.

    Texts stay in tasks. To the driver come at most ``pieces`` pieces of each class, those with the least hashes, and two sizes for each
    calibrating text.
    """
    lab = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("q"))
    lab = lab.where(fold("l_id") != 2).groupBy("l_id").agg(F.min("q").alias("q"), F.max("q").alias("q2")).where("q = q2").drop("q2").withColumn("h", F.xxhash64("l_id"))
    # The least hashes of each class: a top-k, so neither side is sorted as a whole.
    picked = lab.where("q = 1").orderBy("h", "l_id").limit(sample).union(lab.where("q = 0").orderBy("h", "l_id").limit(sample))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))  # 2 * sample rows
    # One text an id, however often it is repeated; every other one of a class makes the dictionary.
    rows = rows.groupBy("h", "doc_id", "q").agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text"))["text"].alias("text"))
    rows = stored(rows, "quality-sample")
    place = F.row_number().over(Window.partitionBy("q").orderBy("h", "doc_id")) % 2
    half = F.broadcast(rows.select(F.col("doc_id").alias("l_id"), F.col("q").alias("l_q"), place.alias("half")))  # 2 * sample rows of numbers
    rows = stored(rows.join(half, (F.col("doc_id") == F.col("l_id")) & (F.col("q") == F.col("l_q"))).select("h", "doc_id", "q", "half", "text"), "quality-sample")
    held = {r["q"]: r["count"] for r in rows.groupBy("q").count().collect()}  # two rows
    if min(held.get(q, 0) for q in (0, 1)) < 8:
        raise ValueError("the quality classifier needs at least 8 labelled documents of each class")
    every = rows.where("half = 1").select("q", "doc_id", "text").mapInPandas(_pieces, "q int, x long, piece binary")
    dicts = {}
    for q in (0, 1):
        own = [bytes(r["piece"]) for r in every.where(F.col("q") == q).orderBy("x", "piece").limit(pieces).collect()]
        try:
            dicts[q] = zstandard.train_dictionary(DICT_BYTES, own).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            dicts[q] = b"".join(own)[:DICT_BYTES]
    model = CompressionModel(dicts[1], dicts[0])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = np.array([shared.value.sizes(t) for t in pdf["text"]], np.int64).reshape(-1, 2)
            yield pdf[["h", "doc_id", "q"]].assign(diff=both[:, 0], size=both[:, 1])
            trim()

    got = rows.where("half = 0").select("h", "doc_id", "q", "text").mapInPandas(measured, "h long, doc_id long, q int, diff long, size long").toPandas().sort_values(["q", "h", "doc_id"])
    dropped(rows)
    # Calibrated to the labels' own shares: the sample holds the classes in other shares.
    share = lab.groupBy("q").count().toPandas().set_index("q")["count"].to_dict()
    y, n = got["q"].to_numpy(float), got.groupby("q").size().to_dict()
    weight = np.array([share[q] / n[q] for q in got["q"]])
    weight *= len(y) / weight.sum()
    sizes = got[["diff", "size"]].to_numpy(float)
    model.average = float(np.average(sizes[:, 0] / np.maximum(sizes[:, 1], 1), weights=weight))
    model.intercept, model.slope = _logistic(model.differences(sizes), y, weight)
    return model


def score_quality(docs: DataFrame, model: CompressionModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1 if score >= threshold, else 0)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        for s in batches:
            yield pd.Series(own.score(s), dtype=float)
            del s
            trim()

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
