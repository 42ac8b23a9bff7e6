"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least 4 q long, that no neighbouring word extends with that period.
All runs of a text are found, in time that grows with its length times the number of scales:

- Periods below 4 are found by comparing the text with itself shifted by 1, 2 and 3 words.
- Scale t = 4, 8, 16, ... finds periods from t up to 2t - 1. Of the places of the text a synchronising set is selected by
  hash: a place i belongs if, of the factors of t words that begin from i to i + t, the least hash is that of the
  first or the last. Whether i belongs depends on the 2t words from i alone, so in a run the set repeats with the run's
  period, and any t places in a row hold one of the set, unless they lie in a highly periodic region.
- Highly periodic regions (factors of t words with a period of at most t / 4) take no part in the hashes: they would fill the
  set. They are parts of runs with small periods, which the scales before have found; these are kept beside and mark
  the regions for the scales after.
- Two places of the set that follow each other with the same 2t words propose their distance as a period. Proposals of one
  distance that overlap merge into a stretch, and the words beside it, fewer than t on either side, complete the run.

Why nothing is lost: let a run have period q, t <= q < 2t, and 4q words. A stretch of 3t - 1 words in it can't have a period of at
most t / 4, as by the periodicity lemma the run would have a smaller period too; so its first t places hold a place s of
the set; s + q has the same 2t words, so it belongs to the set as well, and by the same lemma no place between has them.
Hashes of factors (64 bits, from those of half the length) only propose: each run is compared word by word in the end.

Many texts are searched at once, one after another, each ended by a word that occurs nowhere else; memory grows with one slice
or with one longer text.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to nothing. A null id plants nothing. Repeated
rows give their own rows, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Interned, _mixed, kept_columns, slices, trim

#: A run has at least this many periods, and this many words.
TIMES, WORDS = 4, 6
#: Characters of texts that are searched at once.
AT_ONCE = 2_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _small(w: np.ndarray) -> Runs:
    """Runs with periods 1 to 3: (begin, end, period)."""
    found = []
    for q in (1, 2, 3):
        a, b = _stretches(w[:-q] == w[q:])
        long = b + q - a >= TIMES * q
        a, b = a[long], b[long] + q
        # A smaller period of so long a stretch divides q, so it is 1.
        own = w[a] != w[a + 1] if q == 2 else (w[a] != w[a + 1]) | (w[a] != w[a + 2]) if q == 3 else np.ones(len(a), bool)
        found.append((a[own], b[own], np.full(int(own.sum()), q, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _least(h: np.ndarray, t: int) -> np.ndarray:
    """For each place i the least of h[i : i + t + 1], by running minima of blocks from both sides."""
    k = t + 1
    n = len(h) - t
    padded = np.concatenate((h, np.full(-len(h) % k, _NONE))).reshape(-1, k)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[t : t + n])


def _periodic(places: int, t: int, runs: Runs) -> np.ndarray:
    """Places whose t words lie in a run of a period of at most t / TIMES."""
    a, b, q = runs
    own = (q * TIMES <= t) & (b - a >= t)
    edge = np.zeros(places + 1, np.int64)
    np.add.at(edge, a[own], 1)
    np.add.at(edge, np.minimum(b[own] - t + 1, places), -1)
    return np.cumsum(edge[:-1]) > 0


def synchronising_set(h: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The places of the set at scale t; ``h``: hashes of the factors of t words, ``periodic``: places that take no part."""
    h = np.where(periodic, _NONE, h)
    least = _least(h, t)
    return np.flatnonzero((least != _NONE) & ((h[: len(least)] == least) | (h[t:] == least)))


def _completed(w: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray, t: int) -> Runs:
    """Stretches with their neighbours, up to t words on either side, as far as these keep the period."""
    step = np.arange(1, t + 1)
    out_a, out_b = a.copy(), b.copy()
    for i in range(0, len(a), max(1, 2_000_000 // t)):
        s = slice(i, i + max(1, 2_000_000 // t))
        at = a[s, None] - step
        same = (at >= 0) & (w[np.maximum(at, 0)] == w[np.maximum(at, 0) + q[s, None]])
        out_a[s] -= np.where(same.all(axis=1), t, (~same).argmax(axis=1))
        at = b[s, None] + step - 1
        same = (at < len(w)) & (w[np.minimum(at, len(w) - 1)] == w[np.minimum(at, len(w) - 1) - q[s, None]])
        out_b[s] += np.where(same.all(axis=1), t, (~same).argmax(axis=1))
    return out_a, out_b, q


def _proposed(w: np.ndarray, h: np.ndarray, twice: np.ndarray, t: int, runs: Runs) -> Runs:
    """Runs of periods from t to 2t - 1."""
    s = synchronising_set(h, t, _periodic(len(h), t, runs))
    s = s[s < len(twice)]
    order = np.lexsort((s, twice[s]))
    s = s[order]
    q = s[1:] - s[:-1]
    pair = (twice[s[1:]] == twice[s[:-1]]) & (q >= t) & (q < 2 * t)
    s, q = s[:-1][pair], q[pair]
    order = np.lexsort((s, q))
    s, q = s[order], q[order]
    if not len(s):
        return s, s, s
    # From s on 2t + q words have the period; stretches of one period that share q words are one.
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] > s[:-1] + 2 * t)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(s)])) - 1
    a, b, q = _completed(w, s[first], s[last] + 2 * t + q[first], q[first], t)
    own = b - a >= TIMES * q
    a, b, q = a[own], b[own], q[own]
    exact = np.fromiter((np.array_equal(w[x : y - p], w[x + p : y]) for x, y, p in zip(a, b, q, strict=True)), bool, len(a))
    return a[exact], b[exact], q[exact]


def all_runs(w: np.ndarray, longest: int | None = None) -> Runs:
    """(begin, end, smallest period) of all runs of at least TIMES periods, in order of begin and period.

    ``w``: words as numbers; ``longest``: words of the longest text, if several lie one after another in ``w``.
    """
    longest = len(w) if longest is None else longest
    runs = _small(w) if longest >= TIMES else (np.empty(0, np.int64),) * 3
    t, h = 1, _mixed(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    while t * TIMES <= longest and len(h) > 2 * t:
        twice = _mixed(h[: len(h) - t] * np.uint64(0xD6E8FEB86659FD93) + h[t:])
        if t >= 4:
            runs = tuple(np.concatenate(x) for x in zip(runs, _proposed(w, h, twice, t, runs), strict=True))
        t, h = 2 * t, twice
    order = np.lexsort((runs[2], runs[0]))
    return tuple(x[order].astype(np.int64) for x in runs)


def planted(n: int, key: int) -> np.ndarray | None:
    """The place of the original word at each place of a text of ``n`` words whose id has the checksum ``key``; null: as it is."""
    if key % 10 or not n:
        return None
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _texts(part: pd.DataFrame, plant: bool) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text (after planting), all their numbers with a word that is alone after each text, and the texts' begins."""
    number, own, flat = Interned(), [], []
    for doc, text in zip(part["doc_id"], part["text"], strict=True):
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if plant and doc is not pd.NA and (at := planted(len(words), zlib.crc32(str(doc).encode()))) is not None:
            words = [words[i] for i in at.tolist()]
        own.append(words)
        flat.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        flat.append(np.array([-len(own)], np.int64))
    size = np.fromiter(map(len, own), np.int64, len(own))
    begin = np.cumsum(np.concatenate(([0], size[:-1] + 1))) if len(own) else size
    return own, np.concatenate(flat) if flat else np.empty(0, np.int64), begin


KINDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(words: list[bytes], a: np.ndarray, b: np.ndarray, q: np.ndarray) -> tuple:
    """n_runs, the longest run (ties: smallest begin, then period), digests of the runs and of the collapsed text."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    if not len(a):
        return 0, None, None, None, None, sha(b""), sha(b" ".join(words))
    size = b - a
    best = np.lexsort((q, a, -size))[0]
    lines = "".join(f"{x},{n},{p}\n" for x, n, p in zip(a.tolist(), size.tolist(), q.tolist(), strict=True))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, a + q, 1)
    np.add.at(edge, b, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    x, n, p = int(a[best]), int(size[best]), int(q[best])
    return len(a), x, n, p, 1000 * n // p, sha(lines.encode()), sha(b" ".join([words[i] for i in kept]))


def periodic_runs(docs: DataFrame, plant: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the text without repetitions, for every document.

    A word is dropped from the collapsed text if any run holds it after that run's first period. ``plant``: the texts are
    first made periodic by the rule of the known cases (:func:`planted`). ``at_once``: characters searched at once, about.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf.astype({"doc_id": "Int64"}), at_once):
                own, w, begin = _texts(part, plant)
                a, b, q = all_runs(w, max(map(len, own), default=0))
                long = b - a >= WORDS
                a, b, q = a[long], b[long], q[long]
                cut = np.searchsorted(a, np.append(begin, len(w)))
                rows = [(doc, *_digests(own[i], a[s:e] - begin[i], b[s:e] - begin[i], q[s:e])) for i, (doc, s, e) in enumerate(zip(part["doc_id"], cut[:-1], cut[1:], strict=True))]
                names = [k.split()[0] for k in KINDS.split(", ")]
                yield pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in names[:6]})
            trim()

    return kept_columns(docs, "doc_id", "text").mapInPandas(run, KINDS)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: a row for every run of every text as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf.astype({"doc_id": "Int64"}), AT_ONCE):
                own, w, begin = _texts(part, False)
                a, b, q = all_runs(w, max(map(len, own), default=0))
                text = np.searchsorted(begin, a, side="right") - 1
                long = b - a >= WORDS
                rows = pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[text[long]], "start": (a - begin[text])[long], "length": (b - a)[long], "period": q[long]})
                yield rows.astype({"doc_id": "Int64"})
            trim()

    return kept_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, start long, length long, period long")
