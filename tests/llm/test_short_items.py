"""Benchmark items under 12 words: every pattern of substitutions that the rule allows is found."""

import math
from itertools import combinations

import pytest

from veridan.llm import decontaminate


@pytest.mark.parametrize("n", range(decontaminate.MIN_WORDS, decontaminate.WINDOW + 1))
def test_masks_hit_every_pattern(n):
    masks = decontaminate.MASKS + decontaminate.SHORT_MASKS.get(n, ())
    seeds = [{o + i for i, c in enumerate(m) if c == "1"} for m in masks for o in range(n - len(m) + 1)]
    for bad in combinations(range(n), n - math.ceil(n * decontaminate.AGREE)):
        assert any(not s & set(bad) for s in seeds), bad


def test_short_items_are_found_with_any_substitution(spark):
    sizes = (5, 6, 7, 8, 9, 10, 11, 12)
    items = {n: [f"item{n}word{i}" for i in range(n)] for n in sizes}
    rows, want = [], set()
    for n, words in items.items():
        allowed = n - math.ceil(n * decontaminate.AGREE)
        for k in (allowed, allowed + 1):
            for bad in combinations(range(n), k) if k <= 2 else [(0, n // 2, n - 1)]:
                v = ["other" if i in bad else w for i, w in enumerate(words)]
                if k == allowed:
                    want.add((len(rows), n, n - k, n))
                rows.append((len(rows), " ".join(["before", *v, "after"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench)
    assert {(r["doc_id"], r["item_id"], r["matched"], r["compared"]) for r in got.collect()} == want


def test_one_item_id_with_several_texts(spark, monkeypatch):
    """Each text of an item_id is told apart; the joins by shuffle give what the broadcasts give."""
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(8)]
    bench = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, " ".join(a))], "item_id long, text string")
    docs = spark.createDataFrame([(5, "x " + " ".join(a[:24])), (6, "x " + " ".join(b)), (7, " ".join(a[:10]) + " y")], "doc_id long, text string")
    want = {(5, 1, 20, 20), (5, 2, 20, 20), (6, 1, 8, 8)}
    assert {(r["doc_id"], r["item_id"], r["matched"], r["compared"]) for r in decontaminate.contaminated(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "SEEDS_AT_ONCE", 0)
    monkeypatch.setattr(decontaminate, "STRETCHES_AT_ONCE", 0)
    assert {(r["doc_id"], r["item_id"], r["matched"], r["compared"]) for r in decontaminate.contaminated(docs, bench).collect()} == want
