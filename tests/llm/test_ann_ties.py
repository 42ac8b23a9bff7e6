"""A leaf's nearest vectors where many tie, or where quick distances cancel."""

import numpy as np
import pytest

from veridan.llm import ann_forest


def _ties(rng):
    bits = np.unique(rng.integers(0, 2, (3000, 12)), axis=0).astype(float)
    return bits[bits.any(1)]


def _far(rng):
    return 1e8 + rng.integers(0, 40, (400, 6)) / 16


@pytest.mark.parametrize("make", [_ties, _far, lambda rng: np.eye(60), lambda rng: rng.standard_normal((5, 8))])
@pytest.mark.parametrize("at_once", [7, 100_000])
def test_nearest_is_exact_by_score_and_id(monkeypatch, make, at_once):
    monkeypatch.setattr(ann_forest, "EXACT_ROWS", at_once)
    rng = np.random.default_rng(3)
    v = make(rng)
    ids = rng.permutation(len(v))
    q = v[:20]
    got = [[] for _ in q]
    for row, at, score in ann_forest.nearest_rows(v, ids, (v**2).sum(1), q, 11):
        for r, a, s in zip(row, at, score, strict=True):
            got[r].append((s, ids[a]))
    for i, x in enumerate(q):
        assert got[i] == sorted(zip(np.sqrt(((v - x) ** 2).sum(1)), ids, strict=True))[:11]


def test_ties_in_one_leaf(spark, monkeypatch):
    """60 one-hot vectors are equally far from each other: the ten smallest other ids win."""
    monkeypatch.setattr(ann_forest, "LEAF_SAMPLE", 100)
    t = spark.createDataFrame([((i * 37) % 61, [float(i == j) for j in range(60)]) for i in range(60)], "vec_id long, embedding array<float>")
    out = ann_forest.nearest(t, t.where("vec_id % 20 = 3"), k=10, visit=20.0).collect()
    ids = sorted((i * 37) % 61 for i in range(60))
    for q in (i for i in ids if i % 20 == 3):
        assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in ids if i != q][:10]


def test_recall_at_the_registered_parameters(spark, sf):
    """Noise on a sphere, where no index prunes well: nine of ten true neighbours at least, with exact scores."""
    from veridan.llm import queries

    folder = sf.replace("sf0.001", "sf0.1")
    out = queries.op3_ann_forest(spark, folder).toPandas()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    hit = 0
    for q, own in out.groupby("query_id"):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        score = dict(zip(ids.tolist(), d.tolist(), strict=True))
        assert sorted(own["rank"]) == list(range(1, 11)) and all(score[i] == s for i, s in zip(own["vec_id"], own["score"], strict=True))
        want = sorted((s, i) for i, s in score.items() if i != q)[:10]
        hit += len(set(own["vec_id"]) & {i for _, i in want})
    assert len(out) == 10 * (ids % 100 == 0).sum() and hit >= 0.9 * len(out)


def test_vectors_of_other_lengths_and_clashing_columns(spark):
    rows = [(i, [float(i), 1.0, 2.0], 9, 9) for i in range(1, 40)] + [(100, [1.0, 2.0], 9, 9), (200, [3.0] * 5, 9, 9)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, score int")
    out = ann_forest.nearest(t, t.where("vec_id >= 38"), k=3).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in out} == {(38, 1, 37), (38, 2, 39), (38, 3, 36), (39, 1, 38), (39, 2, 37), (39, 3, 36)}
