"""Link counts of the Jaccard join against brute force."""

import random
import re

import pytest
from veridan.llm import ngram_join


def _want(rows, k, num, den):
    """Links of each row: other distinct (doc_id, set) with a similar set."""

    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return frozenset({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})

    every = {(i, shingles(t)) for i, t in rows if i is not None}
    out = []
    for i, t in rows:
        s = shingles(t)
        n = sum(1 for j, o in every if (j, o) != (i, s) and s and den * len(s & o) >= num * len(s | o)) if i is not None else 0
        out.append((i, len(s), n))
    return out


def _rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", "one two", "One two", "a b c"]
    for size in (30, 120, 400):
        base = [word() for _ in range(size)]
        for _ in range(90):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w[: len(w) - rng.randrange(0, len(w) // 6)]))
    rows = list(enumerate(texts, 10))
    return [*rows, rows[8], rows[8], (rows[8][0], rows[9][1]), (None, texts[8]), (500, texts[8]), (501, texts[8].upper())]


@pytest.mark.parametrize("block", [4_000_000, 2_000])
def test_every_link_counts(spark, block):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(docs, 4, 85, 100, block, count_links=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = _want(rows, 4, 85, 100)
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got), key=key) == sorted(want, key=key)
    assert max(n for *_, n in want) > 50
    plain = ngram_join.jaccard_components(docs, 4, 85, 100, block).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in plain), key=key) == sorted(((r["doc_id"], r["component_id"]) for r in got), key=key)


def test_no_rows(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), count_links=True).count() == 0
