"""Language identification by error-correcting output codes.

Each learned language gets a codeword of ``BITS`` bits, more where the languages are many; a binary character n-gram classifier predicts
each bit. Decoding is loss-weighted: a codeword's distance is the sum over bits of the bit's weight (how
well its classifier separates the training texts) times the logistic loss of its margin. The nearest
codeword names the language; a small gap to the second nearest flags an ambiguous text.

The classifiers are fitted on a bounded sample: ``SAMPLE`` texts, shared by the languages (20 of each at least), those with
the smallest hash of doc_id. Every value of lang is learned. N-grams are counted and classifiers tried in tasks; to the driver
come one table of n-grams for each language, one after another, and the sample's margins, never texts. Prediction reads whole texts.

Defined cases: of several texts of one doc_id and lang the one with the least hash teaches; a null text and one without a letter get ``und``, score 0 and not ambiguous; a single
learned language wins with its own confidence; without any labelled text ValueError is raised. Columns
called like an output column are replaced, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, slices, stored, trim
from .quality import fold

#: Bits of a codeword, hashed n-gram buckets, lengths of n-grams, rows of the sample (shared by the languages).
BITS, BUCKETS, LENGTHS, SAMPLE = 15, 1 << 15, (1, 2, 3, 4), 8000
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """``n`` words of -1/+1, the set with the largest least distance among seeded draws; no bit is constant.

    Five bits more for each doubling of ``n`` beyond 4, so the least distance doesn't fall as languages come in.
    """
    bits = bits or BITS + 5 * max(0, (n - 1).bit_length() - 2)
    best, far = None, -1
    rng = np.random.default_rng(11)
    for _ in range(400 if n <= 40 else 20):
        c = rng.choice([-1, 1], (n, bits))
        if n > 1:
            for b in np.flatnonzero(np.abs(c.sum(0)) == n):
                c[rng.integers(n), b] *= -1
        d = int(((bits - c @ c.T) // 2)[~np.eye(n, dtype=bool)].min()) if n > 1 else bits
        if d > far:
            best, far = c, d
    return best


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams stand in the whole lower-cased text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    total, h = np.zeros(BUCKETS, np.int64), None
    for n in range(1, max(LENGTHS) + 1):
        h = c * np.uint32(0x9E3779B1) if h is None else h[:-1] * np.uint32(0x85EBCA77) + c[n - 1 :]
        if n in LENGTHS:
            g = h ^ (h >> np.uint32(15))
            g *= np.uint32(0xC2B2AE3D)
            g >>= np.uint32(32 - BUCKETS.bit_length() + 1)
            total += np.bincount(g, minlength=BUCKETS)
    return total


@dataclass
class CodeModel:
    langs: list[str]
    codes: np.ndarray  # languages x bits
    tables: np.ndarray  # buckets x bits: weight of an n-gram for each bit
    offset: np.ndarray  # bits
    slope: np.ndarray  # bits: margin for each unit of the mean weight
    bit_weight: np.ndarray
    gap: float = 0.1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def mean_weights(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight of the n-grams of each whole text for each bit; whether it has a letter."""
        sums, has = np.zeros((len(texts), self.codes.shape[1])), np.zeros(len(texts), bool)
        for r, text in enumerate(texts):
            if text and _LETTER.search(text):
                has[r] = True
                c = gram_counts(text)
                sums[r] = c.astype(np.float32) @ self.tables / c.sum()
        return sums, has

    def decode(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword of each row, its confidence, and whether it is ambiguous."""
        margin = (sums - self.offset) * self.slope
        loss = np.logaddexp(0, -margin[:, None, :] * self.codes[None]) @ self.bit_weight
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(p, 1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top[:, -1], top[:, -1] - second < self.gap


def _gram_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each lang of a slice: the sum of its texts' n-gram shares, so each text weighs alike."""
    for pdf in batches:
        for part in slices(pdf):
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(part["lang"], part["text"], strict=True):
                c = gram_counts(text)
                sums[lang] = sums.get(lang, 0) + c / c.sum()
            yield pd.DataFrame({"lang": list(sums), "share": list(sums.values())})
        trim()


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> CodeModel:
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 2)
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").alias("p_id"), F.col("lang").alias("p_lang"), F.xxhash64("doc_id").alias("h"))
    sizes = rows.groupBy(F.col("p_lang").alias("s_lang")).count()
    sizes = stored(sizes, "languages")
    langs = [r["s_lang"] for r in sizes.orderBy("s_lang").collect()]  # the model has a codeword for each
    if not langs:
        raise ValueError("language identification needs labelled texts")
    each = max(20, sample // len(langs))
    # A first cut on the hash, at several times the rows wanted, leaves the ranking little to do.
    share = F.broadcast(sizes.select("s_lang", F.least(F.lit(1.0), F.lit(4.0 * (each + 25)) / F.col("count")).alias("share")))  # a row a language
    picked = rows.join(share, F.col("p_lang") == F.col("s_lang")).where(F.pmod("h", F.lit(1_000_003)) <= F.col("share") * 1_000_003).select("p_id", "p_lang", "h").distinct()
    picked = picked.withColumn("r", F.expr("row_number() over (partition by p_lang order by h, p_id)")).where(F.col("r") <= each)
    got = docs.select("doc_id", "text", "lang").join(
        F.broadcast(picked.select("p_id", "p_lang")), (F.col("doc_id") == F.col("p_id")) & (F.col("lang") == F.col("p_lang"))  # ``each`` rows a language
    ).where(F.col("text").rlike(r"\p{L}"))
    # One text for each id and language, however often rows are repeated.
    got = stored(got.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text"))["text"].alias("text")), "language-sample")

    at = {x: i for i, x in enumerate(langs)}
    codes = codewords(len(langs))
    # A bit's table: the mean share of the languages with +1 against that of those with -1.
    sides = {1: np.zeros((BUCKETS, codes.shape[1])), -1: np.zeros((BUCKETS, codes.shape[1]))}
    own, name = None, None

    def add() -> None:
        own_share = own / max(own.sum(), 1e-12) + 1e-6
        for side, table in sides.items():
            table[:, codes[at[name]] == side] += own_share[:, None]

    for r in got.select("lang", "text").mapInPandas(_gram_sums, "lang string, share array<double>").orderBy("lang").toLocalIterator():
        if r["lang"] != name:
            if name is not None:
                add()
            own, name = np.zeros(BUCKETS), r["lang"]
        own += np.array(r["share"])
    add()
    n = {side: (codes == side).sum(0) for side in sides}
    both = (n[1] > 0) & (n[-1] > 0)
    tables = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    tables[:, both] = np.log(sides[1][:, both] / n[1][both]) - np.log(sides[-1][:, both] / n[-1][both])
    trial = docs.sparkSession.sparkContext.broadcast(tables)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "lang"]].assign(s=[c.astype(np.float32) @ trial.value / c.sum() for c in map(gram_counts, pdf["text"])])
            trim()

    tried = got.mapInPandas(margins, "doc_id long, lang string, s array<double>").toPandas().sort_values(["doc_id", "lang"])
    dropped(got, sizes)
    y, s = np.array([at[x] for x in tried["lang"]]), np.array(tried["s"].tolist())
    offset, slope, weight = np.zeros(codes.shape[1]), np.ones(codes.shape[1]), np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        hi, lo = s[codes[y, b] > 0, b], s[codes[y, b] < 0, b]
        if len(hi) and len(lo):
            offset[b] = (np.median(hi) + np.median(lo)) / 2
            slope[b] = 6 / max(np.median(hi) - np.median(lo), 1e-3)
            right = ((hi > offset[b]).mean() + (lo < offset[b]).mean()) / 2
            weight[b] = max(right - 0.5, 0.01) * 2
    return CodeModel(langs, codes, tables, offset, slope, weight / weight.mean())


def identify(docs: DataFrame, model: CodeModel) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        names = np.array(own.langs, object)
        for s in batches:
            sums, has = own.mean_weights(s.tolist())
            best, score, unsure = own.decode(sums)
            yield pd.DataFrame(
                {"lang_pred": np.where(has, names[best], "und"), "score": np.where(has, score, 0.0), "ambiguous": has & unsure}
            )
            del s, sums
            trim()

    out = docs.withColumn("_ecoc", predict("text"))
    return out.withColumns({c: F.col(f"_ecoc.{c}") for c in ("lang_pred", "score", "ambiguous")}).drop("_ecoc")
