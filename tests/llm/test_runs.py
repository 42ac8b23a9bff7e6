"""Runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veridan.llm import runs


def _brute(w):
    """(begin, end, period) of all runs of at least four periods."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if len(own) >= 4 * q and j > i and all(any(own[k] != own[k + r] for k in range(len(own) - r)) for r in range(1, q)):
                out.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def _found(w):
    return list(zip(*[x.tolist() for x in runs.all_runs(np.array(w, np.int64))], strict=True))


def _repetitive(rng, n):
    w, k = [], rng.choice([1, 2, 2, 3, 5, 50])
    while len(w) < n:
        way = rng.randrange(4)
        if way == 0 or not w:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
        elif way == 3:
            w += [rng.randrange(k)] * rng.randrange(1, 9)
        else:
            p = rng.randrange(1, min(60, len(w)) + 1)
            s = len(w) - p if way == 1 else rng.randrange(len(w) - p + 1)
            w += w[s : s + p] * rng.randrange(1, 9)
    return w[:n]


def test_repetitive_words():
    rng, total = random.Random(7), 0
    for _ in range(400):
        w = _repetitive(rng, rng.randrange(300))
        want = _brute(w)
        total += len(want)
        assert _found(w) == want, w
    assert total > 2000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_any_words(w):
    assert _found(w) == _brute(w)


def test_long_periods():
    rng = np.random.default_rng(1)
    root = rng.integers(0, 1000, 5000)
    w = np.concatenate((rng.integers(0, 1000, 300), np.tile(root, 5)[:22_000], [1001], np.tile(root[:33], 4), [1002, 7, 7, 7, 7]))
    assert {(b - a, q) for a, b, q in _found(w)} >= {(22_000, 5000), (132, 33), (4, 1)}


@pytest.mark.parametrize("t", [4, 8, 16])
def test_set_is_consistent_and_dense(t):
    """Equal 2t words belong or don't belong alike, and t places hold one of the set outside highly periodic regions."""
    w = np.array(_repetitive(random.Random(t), 900))
    h = np.array([hash(tuple(w[i : i + t].tolist())) & 0xFFFFFFFFFFFF for i in range(len(w) - t + 1)], np.uint64)
    found = runs.all_runs(w)
    periodic = runs._periodic(len(h), t, found)
    assert periodic.tolist() == [any(all(w[i + j] == w[i + j + r] for j in range(t - r)) for r in range(1, t // 4 + 1)) for i in range(len(h))]
    own = set(runs.synchronising_set(h, t, periodic).tolist())
    last = len(w) - 2 * t
    seen = {}
    for i in range(last + 1):
        assert seen.setdefault(tuple(w[i : i + 2 * t].tolist()), i in own) == (i in own)
    for i in range(last + 1 - t):
        assert own & set(range(i, i + t)) or periodic[i : i + 2 * t].all()


def _contract(doc_id, text):
    """The contract word by word, with the search above."""
    words = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = [(a, b - a, q) for a, b, q in _brute(words) if b - a >= max(6, 4 * q)]
    gone = {i for a, n_, q in own for i in range(a + q, a + n_)}
    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    shape = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(own), *shape, sha("".join(f"{a},{m},{q}\n" for a, m, q in own).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(300):
        w = [rng.choice("a b c d e É Aa zz".split()) for _ in range(rng.randrange(60))] if i % 2 else [f"w{x}" for x in _repetitive(rng, rng.randrange(150))]
        out.append((i, rng.choice([" ", "\n", "\t \x0b", " \u3000 "]).join(w), "own", 1))
    return [*out, (None, "x " * 9, "", 0), (301, None, "", 0), (302, "", "", 0), (303, " \n", "", 0), (5, "a b " * 8, "", 0), (5, "a b " * 8, "", 0), (9, "x\u0085x x\u00a0x " * 7, "", 0)]


@pytest.mark.parametrize("at_once", [runs.AT_ONCE, 200])
def test_contract(spark, rows, at_once):
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, start int")
    got = [tuple(r) for r in runs.periodic_runs(docs, plant=True, at_once=at_once).collect()]
    want = [_contract(d, t) for d, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[1] > 0 for w in want) > 100
    assert runs.periodic_runs(spark.createDataFrame([], docs.schema)).count() == 0


def test_spans(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, start int")
    got = sorted((tuple(r) for r in runs.spans(docs).collect()), key=str)
    want = [(d, a, b - a, q) for d, t, *_ in rows for a, b, q in _brute([x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) if b - a >= max(6, 4 * q)]
    assert got == sorted(want, key=str)
