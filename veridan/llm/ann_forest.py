"""Approximate nearest neighbours: a forest of random-projection trees with a shared priority queue.

The trees are grown on the driver from a bounded sample (``SAMPLE`` vectors with the smallest hash of
their id); every vector is routed to one leaf of each tree. A query descends all trees through one priority
queue, ordered by the sum of the squared margins it had to cross (with nearly orthogonal planes the squared
distance to the leaf's cell), until the leaves it took hold enough vectors.

Neighbouring leaves of a tree form groups, eight a tree and more only where a group would pass ``leaf_rows``
vectors. A group's vectors meet the queries that took some of its leaves in one task, where exact distances
on the original vectors keep each query's best of all those leaves: a row a query and group leaves the task
for each neighbour, not a row a leaf. A group that one leaf of very many vectors makes too large is
split over tasks; equal vectors are one candidate that carries its smallest ids.

Nearness is the Euclidean distance in double precision, ties to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do
null ids and vectors of another length than the table's most frequent one (ties: the longer), queries included.
A repeated id with equal vectors counts once; with different vectors it is several candidates, and as a query
its least vector asks. A query never finds its own id. With fewer candidates than ``k`` all are returned. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Trees, vectors of the sample, fewest of the sample in a leaf, leaves of a tree, groups of leaves in a tree, vectors of a group.
TREES, SAMPLE, LEAF_SAMPLE, LEAVES, GROUPS, LEAF_ROWS = 6, 20_000, 4, 1024, 8, 50_000
#: Vectors that a query's leaves hold in all trees together, as a share of the indexed vectors. On uniform
#: noise in 64 dimensions, where no index prunes well, this looks at about half of the rows and gives a
#: recall of 0.94 and more; clustered data need far less.
VISIT = 0.75
#: Vectors that they hold at least: few vectors lie farther apart, and a search needs more of them.
VISIT_LEAST = 4000
#: What a sum of products may be off by, for each term, as a share of the norms: twice the spacing of doubles.
_ROUNDING = 2 * np.finfo(float).eps
EXACT_ROWS = 100_000  # candidates whose exact distances are made at once
CELLS = 1 << 21  # quick distances that are held at once


@dataclass
class Tree:
    planes: np.ndarray  # inner nodes x dimensions
    cuts: np.ndarray
    kids: np.ndarray  # inner nodes x 2: an inner node, or -1 - leaf
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(x), np.int64) if len(self.cuts) else np.full(len(x), -1)
        while (go := np.flatnonzero(at >= 0)).size:
            node = at[go]
            side = (np.einsum("ij,ij->i", x[go], self.planes[node]) > self.cuts[node]).astype(int)
            at[go] = self.kids[node, side]
        return -1 - at


def grow(x: np.ndarray, cap: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    planes, cuts, kids, leaves = [], [], [], 0
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        idx, parent, side = stack.pop()
        split = None
        if len(idx) > cap:
            a, b = x[rng.choice(idx, 2, replace=False)]
            w = a - b if np.any(a != b) else rng.standard_normal(x.shape[1])
            w = w / np.linalg.norm(w)
            p = x[idx] @ w
            cut = float(np.median(p))
            if (p > cut).any():
                split = idx[p <= cut], idx[p > cut]
        if split is None:
            me, leaves = -1 - leaves, leaves + 1
        else:
            me = len(cuts)
            planes.append(w), cuts.append(cut), kids.append([0, 0])
            stack += [(split[0], me, 0), (split[1], me, 1)]
        if parent >= 0:
            kids[parent][side] = me
    return Tree(np.array(planes).reshape(-1, x.shape[1]), np.array(cuts), np.array(kids, np.int64).reshape(-1, 2), leaves)


def taken_leaves(forest: list[Tree], counts: dict[tuple[int, int], int], q: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until they hold ``least`` vectors."""
    margins = [t.planes @ q - t.cuts for t in forest]
    heap = [(0.0, i, 0 if len(t.cuts) else -1) for i, t in enumerate(forest)]
    out, held = [], 0
    while heap and held < least:
        far, i, node = heapq.heappop(heap)
        while node >= 0:
            m = margins[i][node]
            near = int(m > 0)
            heapq.heappush(heap, (far + m * m, i, int(forest[i].kids[node, 1 - near])))
            node = int(forest[i].kids[node, near])
        if n := counts.get((i, -1 - node), 0):
            out.append((i, -1 - node))
            held += n
    return out


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vid, vec of the rows that can take part, of any length."""
    v = table.select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).alias("vec")).where("vid IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    return v.where("forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)")


def nearest_rows(
    m: np.ndarray, ids: np.ndarray, square: np.ndarray, q: np.ndarray, keep: int, allowed: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``q``, row of ``m``, distance): of each query the ``keep`` first rows of ``m`` by (distance, id), exactly.

    Quick distances leave out only what is farther than the last one kept by more than they may round.
    ``allowed`` (queries x rows) leaves out what a query may not have.
    """
    keep = min(len(m), keep)
    quick = square - 2 * q @ m.T
    if allowed is not None:
        quick[~allowed] = np.inf
    slack = _ROUNDING * (m.shape[1] + 4) * (np.sqrt(square)[None, :] + np.sqrt((q**2).sum(1))[:, None]) ** 2
    cut = np.partition(quick + slack, keep - 1, 1)[:, keep - 1 : keep]
    near = ~(quick - slack > cut)  # what is not a number stays
    if allowed is not None:
        near &= allowed
    row, at = np.nonzero(near)
    piece = (np.cumsum(near.sum(1)) // EXACT_ROWS)[row]
    for p in np.unique(piece):
        r, a = row[piece == p], at[piece == p]
        score = np.sqrt(((m[a] - q[r]) ** 2).sum(1))
        by = np.lexsort((ids[a], score, r))
        r, a, score = r[by], a[by], score[by]
        first = np.arange(len(r)) - np.searchsorted(r, r) < keep
        yield r[first], a[first], score[first]


def leaf_groups(counts: np.ndarray, groups: int) -> np.ndarray:
    """The group of each leaf: leaves in their order, cut where their vectors reach the next share of all."""
    before = np.cumsum(counts) - counts
    return np.minimum(before * groups // max(int(counts.sum()), 1), groups - 1).astype(np.int32)


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    trees: int = TREES, sample: int = SAMPLE, visit: float = VISIT, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows of ``table`` that the forest found."""
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = valid_vectors(table, id_col, vec_col)
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not dims:
        return spark.createDataFrame([], out)
    of_length = F.size("vec") == dims["d"]
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
    ranked = rows.where(of_length).distinct().withColumn("r", F.expr("row_number() over (partition by vec order by vid)")).where(F.col("r") <= k + 1)
    vectors = ranked.groupBy("vec").agg(F.min("vid").alias("vid"), F.array_sort(F.collect_list("vid")).alias("ids"))
    vectors = stored(vectors, "ann-vectors")
    n = vectors.count()
    seed_rows = vectors.orderBy(F.xxhash64("vid"), "vid").limit(sample).select("vec").toPandas()
    x = np.stack(seed_rows["vec"].to_numpy()).astype(float)
    cap = max(LEAF_SAMPLE, -(-len(x) // LEAVES))
    forest = spark.sparkContext.broadcast([grow(x, cap, 100 + t) for t in range(trees)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["vec"].to_numpy()).astype(float)
                yield pdf.assign(leaves=list(np.stack([t.route(m) for t in forest.value], 1).astype(np.int32)))

    vec_type = vectors.schema["vec"].dataType.simpleString()
    routed = stored(vectors.mapInPandas(route, f"vec {vec_type}, vid long, ids array<long>, leaves array<int>"), "ann-routed")
    dropped(vectors)
    # A row a leaf: bounded by the sample.
    counts = {(r["tree"], r["leaf"]): r["count"] for r in routed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().toLocalIterator()}
    held = spark.sparkContext.broadcast(counts)
    n_groups = max(GROUPS, -(-n // leaf_rows))
    of_leaf, splits = [], {}
    for t, tree in enumerate(forest.value):
        own = np.array([counts.get((t, v), 0) for v in range(tree.leaves)], np.int64)
        of_leaf.append(leaf_groups(own, n_groups))
        size = np.bincount(of_leaf[-1], own, n_groups)
        splits |= {(t, int(g)): int(-(-size[g] // leaf_rows)) for g in np.flatnonzero(size > 2 * leaf_rows)}
    places = F.array(*[F.array(*[F.lit(int(g)) for g in own]) for own in of_leaf])  # a number a leaf
    placed = routed.select("vid", "ids", "vec", F.posexplode("leaves").alias("tree", "leaf")).withColumn("part", F.get(F.get(places, F.col("tree")), F.col("leaf")))
    if splits:
        wide = spark.createDataFrame([(t, g, s) for (t, g), s in splits.items()], "tree int, part int, salts int")
        placed = placed.join(F.broadcast(wide), ["tree", "part"], "left").withColumn("salt", F.expr("cast(pmod(xxhash64(vid), coalesce(salts, 1)) as int)"))  # a row a group
    else:
        placed = placed.withColumn("salt", F.lit(0))
    placed = placed.select("tree", "part", "salt", "leaf", "vid", "ids", "vec")
    least = max(VISIT_LEAST, k + 1, int(visit * n))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, v in zip(pdf["query_id"], pdf["q"], strict=True):
                got: dict[tuple[int, int], list[int]] = {}
                for t, f in taken_leaves(forest.value, held.value, np.asarray(v, float), least):
                    got.setdefault((t, int(of_leaf[t][f])), []).append(f)
                rows = [(q, v, t, g, s, leaves) for (t, g), leaves in got.items() for s in range(splits.get((t, g), 1))]
                yield pd.DataFrame(rows, columns=["query_id", "q", "tree", "part", "salt", "leaves"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = valid_vectors(queries, id_col, vec_col).where(of_length).groupBy(F.col("vid").alias("query_id")).agg(F.min("vec").alias("q"))
    asked = asked.repartition(parts, "query_id").mapInPandas(descend, f"query_id long, q {vec_type}, tree int, part int, salt int, leaves array<int>")

    def best(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": [], "vid": [], "ids": [], "score": []}, dtype=object)
        m, found = np.stack(own["vec"].to_numpy()).astype(float), []
        names, ids, leaf, square = own["vid"].to_numpy(), own["ids"].to_numpy(), own["leaf"].to_numpy(), (m**2).sum(1)
        step = max(1, CELLS // len(m))
        for i in range(0, len(ask), step):
            some = ask.iloc[i : i + step]
            taken = np.zeros((len(some), int(leaf.max()) + 1), bool)
            for r, leaves in enumerate(some["leaves"]):
                taken[r, leaves[leaves < taken.shape[1]]] = True
            q = np.stack(some["q"].to_numpy()).astype(float)
            for row, at, score in nearest_rows(m, names, square, q, k + 1, taken[:, leaf]):
                found.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[row], "vid": names[at], "ids": ids[at], "score": score}))
        return pd.concat(found)

    by = ["tree", "part", "salt"]
    found = placed.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(best, "query_id long, vid long, ids array<long>, score double")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    found = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)"))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
