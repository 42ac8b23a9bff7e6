"""N-gram Jaccard join by signature trees.

Two documents link when ``den * |A & B| >= num * |A | B|`` on their sets of word shingles. The join is
exact; no pair is lost to a cap and no key is dropped.

1. Equal sets fold into one (a partial aggregate, so a hot copy costs one row a task).
2. Every set gives the keys of a prefix in hash order, long enough that similar sets share at least
   ``need`` keys. Keys are counted in one shuffle; hot keys, which a sample of the sets shows, are shared
   for certain, and their rows are dealt by a salt. A document with fewer shared keys than any partner would
   leave it takes no further part. This is repeated on what remains.
3. What still shares keys, among sets of a size that allows it, falls into clusters; each pair that can
   link lies inside one cluster.
4. A task gets the documents of one cluster (or two blocks of a large one), builds signature trees,
   whose nodes hold OR-combined token bitmaps and size ranges, and descends two trees at once. A node
   pair goes when its largest possible overlap is too small or, where links aren't counted, when all below is
   linked already. Pairs of leaves are verified on the exact sets.
5. Links become components.

Defined cases: null or word-less text: empty set, linked with nothing. Rows with the same doc_id are one
vertex, whatever their texts; each row is returned. A null doc_id is returned with its n_shingles and takes no part. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_slices, components, dropped, forget, kept_columns, shingle_sets, slices, stored, trim

#: Shingles that one block of a cluster holds at most (32 MB of hashes); a larger document has its own block.
BLOCK_SHINGLES = 4_000_000
#: Characters of text whose shingles are made at once.
CHARS = 2_000_000
#: One set in so many is looked at for hot keys, and how often a hot key stands in that sample at least.
SAMPLED, HOT = 64, 16
#: Hot keys that are told apart at most, the most frequent first (any other goes the common way), and the salts of each.
HOT_KEYS, SALTS = 100_000, 256
#: 64-bit words of the bitmap that keeps texts without a partner out of a shuffle (4 MB).
BITMAP = 1 << 19
#: Sets below a lowest node, and nodes below a higher one.
LEAF, FANOUT = 64, 8
#: Common shingles whose 0/1 matrices are multiplied at once (16 MB a side).
COLUMNS = 1 << 16


def _least_overlap(n, num: int, den: int):
    """Shingles that a set of ``n`` shares with any similar set, at least."""
    return -(-num * n // den)


def _need(n):
    """Prefix keys that a set of ``n`` shares with a similar set that is no smaller."""
    return 1 + n // 20


# --- signature trees ----------------------------------------------------------------------------


class SignatureTree:
    """Nodes level by level over sets in a given order: level 0 has a node for each set, level 1 for each LEAF of them."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        sig = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(sig[i], (at >> np.uint64(6)).astype(np.intp), np.uint64(1) << (at & np.uint64(63)))
        excess = sizes - np.bitwise_count(sig).sum(1, dtype=np.int64)
        #: per level: bitmaps, smallest size, largest size, largest number of shingles that share a bit with others
        self.levels = [(sig, sizes, sizes, excess)]
        while len(self.levels) < 2 or len(self.levels[-1][0]) > 1:
            sig, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(sig), LEAF if len(self.levels) == 1 else FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at))
            )

    def kids(self, level: int, node: int) -> np.ndarray:
        step = LEAF if level == 1 else FANOUT
        return np.arange(node * step, min((node + 1) * step, len(self.levels[level - 1][0])))

    def own(self, level: int, node: int) -> slice:
        """Places of the sets below a node."""
        step = LEAF * FANOUT ** (level - 1)
        return slice(node * step, (node + 1) * step)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _fits(one: tuple, at: np.ndarray, other: tuple, to: np.ndarray, num: int, den: int) -> np.ndarray:
    """Matrix: may a set below a node of ``one`` be similar to one below a node of ``other``?"""
    (sig, lo, hi, ex), (sig2, lo2, hi2, ex2) = (tuple(x[i] for x in t) for t, i in ((one, at), (other, to)))
    ok = (hi2[None] * den >= num * lo[:, None]) & (hi[:, None] * den >= num * lo2[None])
    a, b = np.nonzero(ok)
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        most = np.bitwise_count(sig[x] & sig2[y]).sum(1, dtype=np.int64) + np.minimum(ex[x], ex2[y])
        most = np.minimum(most, np.minimum(hi[x], hi2[y]))
        # |A & B| >= t/(1+t) * (|A| + |B|)
        ok[x, y] = most * (num + den) >= num * (lo[x] + lo2[y])
    return ok


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _trees(sets: list[np.ndarray], split: int) -> tuple[list[SignatureTree], list[np.ndarray]]:
    """A tree over all sets, or one over the first ``split`` and one over the rest; and the places of their sets in order."""
    mean = max(64, int(np.mean([len(s) for s in sets])))
    bits = 1 << int(np.ceil(np.log2(8 * min(mean, 8192))))
    trees, orders = [], []
    for a, b in [(0, len(sets))] if not split else [(0, split), (split, len(sets))]:
        # Near copies share their smallest hashes: they come to lie beside each other.
        order = sorted(range(a, b), key=lambda i: (int(sets[i][0]), int(sets[i][min(1, len(sets[i]) - 1)]), len(sets[i])))
        orders.append(np.array(order))
        trees.append(SignatureTree([sets[i] for i in order], bits))
    return trees, orders


def _descend(left: SignatureTree, right: SignatureTree, num: int, den: int, done: Callable[[int, int, int, int], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of lowest nodes that may hold similar sets. ``done`` names node pairs that need no look."""
    same = left is right
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        if done(la, a, lb, b):
            continue
        if la == 1 and lb == 1:
            yield a, b
        elif same and la == lb and a == b:
            kids = left.kids(la, a)
            ok = _fits(left.levels[la - 1], kids, left.levels[la - 1], kids, num, den)
            pairs = [(i, j) for i in range(len(kids)) for j in range(i + 1) if ok[i, j]]
            # A node with itself last, so that it is taken first: later pairs find much of it connected.
            pairs.sort(key=lambda p: p[0] == p[1])
            stack += [(la - 1, int(kids[i]), lb - 1, int(kids[j])) for i, j in pairs]
        elif la >= lb:
            kids = left.kids(la, a)
            ok = _fits(left.levels[la - 1], kids, right.levels[lb], np.array([b]), num, den)[:, 0]
            stack += [(la - 1, int(k), lb, b) for k in kids[ok]]
        else:
            kids = right.kids(lb, b)
            ok = _fits(left.levels[la], np.array([a]), right.levels[lb - 1], kids, num, den)[0]
            stack += [(la, a, lb - 1, int(k)) for k in kids[ok]]


def tree_links(sets: list[np.ndarray], split: int, num: int, den: int, joined: list[int]) -> list[tuple[int, int]]:
    """Verified links (i, j) that connect all similar sets: between the first ``split`` sets and the rest, or
    among all when ``split`` is 0. ``joined`` numbers sets that are known to be connected alike.
    Links inside what is connected already are not looked for.
    """
    if len(sets) < 2:
        return []
    trees, orders = _trees(sets, split)
    left, right, same = trees[0], trees[-1], not split
    left_order, right_order = orders[0], orders[-1]
    union = _Union(len(sets))
    first: dict[int, int] = {}
    for i, c in enumerate(joined):
        union.join(first.setdefault(c, i), i)
    root = np.vectorize(union.root, otypes=[np.int64])

    def connected(la: int, a: int, lb: int, b: int) -> bool:
        ra, rb = root(left_order[left.own(la, a)]), root(right_order[right.own(lb, b)])
        return bool((ra == ra[0]).all() and (rb == ra[0]).all())

    links = []
    for a, b in _descend(left, right, num, den, connected):
        x, y = left.kids(1, a), right.kids(1, b)
        todo = _fits(left.levels[0], x, right.levels[0], y, num, den) & (root(left_order[x])[:, None] != root(right_order[y])[None])
        if same and a == b:
            todo &= np.tri(len(x), k=-1, dtype=bool)
        while todo.any():
            i, j = np.unravel_index(todo.argmax(), todo.shape)
            todo[i, j] = False
            p, q = int(left_order[x[i]]), int(right_order[y[j]])
            if _similar(sets[p], sets[q], num, den):
                union.join(p, q)
                links.append((p, q))
                todo &= root(left_order[x])[:, None] != root(right_order[y])[None]
    return links


def _overlaps(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Matrix of the intersections' sizes, by a product of 0/1 matrices, ``COLUMNS`` common shingles at a time."""
    x, y = np.concatenate(one), np.concatenate(other)
    common = np.intersect1d(x, y)
    out = np.zeros((len(one), len(other)), np.int64)
    if not len(common):
        return out
    places = []
    for flat, sets in ((x, one), (y, other)):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        held = common[at] == flat
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held]))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for (row, at), n in zip(places, out.shape, strict=True):
            here = (at >= start) & (at < start + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(common) - start)), np.float32)
            m[row[here], at[here] - start] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def tree_counts(sets: list[np.ndarray], split: int, num: int, den: int, weights: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The weights of all sets similar to each set, summed, and links that connect similar sets.

    Every pair that the trees leave is verified: between the first ``split`` sets and the rest, or among all when
    ``split`` is 0. Pairs of two sets that are not ``low`` are left to another cluster.
    """
    counts = np.zeros(len(sets), np.int64)
    if len(sets) < 2:
        return counts, []
    trees, orders = _trees(sets, split)
    left, right, same = trees[0], trees[-1], not split
    left_order, right_order = orders[0], orders[-1]
    union = _Union(len(sets))
    root = np.vectorize(union.root, otypes=[np.int64])
    links = []
    for a, b in _descend(left, right, num, den, lambda la, a, lb, b: False):
        x, y = left.kids(1, a), right.kids(1, b)
        p, q = left_order[x], right_order[y]
        found = _fits(left.levels[0], x, right.levels[0], y, num, den) & (low[p][:, None] | low[q][None])
        if same and a == b:
            found &= np.tri(len(x), k=-1, dtype=bool)
        i, j = np.nonzero(found)
        if len(i) <= 32:
            for m, n in zip(i, j, strict=True):
                found[m, n] = _similar(sets[p[m]], sets[q[n]], num, den)
        else:
            at, to = np.unique(i), np.unique(j)
            both = _overlaps([sets[m] for m in p[at]], [sets[n] for n in q[to]])
            sizes = left.levels[0][1][x[at]][:, None] + right.levels[0][1][y[to]][None]
            found[np.ix_(at, to)] &= den * both >= num * (sizes - both)
        if not found.any():
            continue
        np.add.at(counts, p, found @ weights[q])
        np.add.at(counts, q, weights[p] @ found)
        found &= root(p)[:, None] != root(q)[None]
        for m, n in zip(*np.nonzero(found), strict=True):
            if union.root(int(p[m])) != union.root(int(q[n])):
                union.join(int(p[m]), int(q[n]))
                links.append((int(p[m]), int(q[n])))
    return counts, links


# --- the job ------------------------------------------------------------------------------------


def _base(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, its prefix keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, CHARS):
                sets = shingle_sets(part["text"], k)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "n": [len(s) for s in sets],
                        "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                        "keys": [s[: len(s) - _least_overlap(len(s), num, den) + _need(len(s))].view(np.int64) for s in sets],
                    }
                )
                del sets
            trim()

    return kept_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, n long, digest binary, keys array<long>")


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, block_shingles: int = BLOCK_SHINGLES, count_links: bool = False
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    With ``count_links`` also n_links: how many other documents (distinct pairs of doc_id and set) the row's set links
    with, copies included. Every similar pair of different sets is then verified, where components alone need only as
    many links as connect them; no pair leaves its task, only sums by set do. A cluster of many blocks is
    compared block by block, each pair of blocks in its own task.
    """
    spark = docs.sparkSession
    base = stored(_base(docs, k, num, den), "jaccard-base")
    reps = base.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    # Keys that many sets hold, by their number in a sample of the sets: a bounded table.
    some = base.where("n > 0 AND doc_id IS NOT NULL").where(F.pmod(F.xxhash64("digest"), F.lit(SAMPLED)) == 0).dropDuplicates(["digest"])
    hot = some.select(F.explode("keys").alias("hot")).groupBy("hot").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "hot").limit(HOT_KEYS)
    hot = F.broadcast(stored(hot.select("hot"), "jaccard-hot"))  # HOT_KEYS rows at most
    keyed = reps.select("rep", "n", F.explode("keys").alias("key")).join(hot, F.col("key") == F.col("hot"), "left")
    keyed = keyed.select("rep", "n", "key", F.expr(f"if(hot IS NULL, 0, 1 + int(pmod(xxhash64(rep), {SALTS})))").alias("salt"))
    rows = stored(_shared(keyed, [], num, den), "jaccard-keys")
    # Similar sets differ in size by the factor num/den at most, so they lie in one size class or in two
    # neighbouring ones; each set stands in both windows of two classes that hold its own.
    size_class = F.floor(F.log(F.col("n")) / float(np.log(den / num * 1.0001)))
    windows = rows.select("key", "salt", "rep", "n", F.explode(F.array(size_class, size_class - 1)).alias("window"))
    for _ in range(2):
        windows, last = stored(_shared(windows, ["window"], num, den), "jaccard-windows"), rows
        dropped(last)
        rows = windows
    windows = windows.withColumn("node", F.xxhash64("rep", "window"))
    # All nodes of a key go to its least one: within each salt of a hot key first, then the salts' least ones.
    edges = windows.select("key", "window", "salt", F.col("node").alias("a"), F.expr("min(node) over (partition by key, window, salt)").alias("b"))
    salted = windows.where("salt > 0").groupBy("key", "window", "salt").agg(F.min("node").alias("a"))
    salted = salted.select("a", F.expr("min(a) over (partition by key, window)").alias("b"))
    clusters = stored(components(edges.select("a", "b").union(salted)), "jaccard-clusters")

    # Blocks of a cluster, by a hash of the document; most clusters have one block.
    sized = windows.select("node", "rep", "n", (size_class == F.col("window")).alias("low")).distinct().join(clusters, "node")
    big = sized.groupBy("component").agg(F.sum("n").alias("total"))
    sized = sized.join(big, "component").withColumn("blocks", F.ceil(F.col("total") / block_shingles).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    named = base.where("n > 0 AND doc_id IS NOT NULL")
    copies = named.select("digest", "doc_id").distinct().groupBy("digest").agg(F.count("*").alias("copies"))
    if count_links:
        of_set = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).join(copies, "digest")
        sized = sized.join(of_set, ["rep", "n"])
        members = sized.select(F.col("rep").alias("node"), "component", "blocks", "block", "digest", "copies", "low")
    else:
        members = sized.select(F.col("rep").alias("node"), "component", "blocks", "block")
    members = stored(members.distinct(), "jaccard-members")
    dropped(rows)
    texts = _likely(kept_columns(docs, "doc_id", "text"), members.select("node")).join(members, F.col("doc_id") == F.col("node")).drop("node")
    if count_links:
        found = stored(_counted(texts, k, num, den), "jaccard-counted")
        links, counted = found.where("a IS NOT NULL").select("a", "b"), found.where("a IS NULL")
    else:
        links, counted = _connecting(texts, members, k, num, den), None
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "jaccard-pairs")
    # A doc_id with several texts ties the representatives of these together.
    several = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    of_digest = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    ties = named.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(of_digest, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = stored(components(links.union(ties)), "jaccard-final")
    linked = of_digest.join(final, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    if count_links:
        degree = counted.groupBy("digest").agg(F.sum("links").alias("others"))
        linked = linked.join(copies, "digest").join(degree, "digest", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    out = base.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.col("digest")).alias("digest"))
    count = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return out.join(linked, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *count)


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id is not in ``ids``, so that a join shuffles fewer texts.

    A bitmap of fixed size goes to the tasks; where very many ids fill it, more rows pass, and none is lost.
    """
    at = F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITMAP * 64))
    words = ids.select(at.alias("h")).groupBy(F.expr("h div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("bits")).toPandas()
    bits = np.zeros(BITMAP, np.int64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        h = h.to_numpy(np.int64)
        return pd.Series(((held.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)) == 1)

    return docs.where("doc_id IS NOT NULL").where(likely(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP * 64))))


def _shared(rows: DataFrame, by: list[str], num: int, den: int) -> DataFrame:
    """The rows whose key others have too, of sets that have as many of them as a similar set would leave.

    Rows with a salt are of hot keys, which are shared for certain.
    """
    count = F.expr(f"count(1) over (partition by {', '.join(['key', *by, 'salt'])})")
    rows = stored(rows.withColumn("df", count).where("df > 1 OR salt > 0").drop("df"), "jaccard-shared")
    own = ["rep", "n", *by]
    c = F.expr(f"({num} * n + {den} - 1) div {den}")
    enough = rows.groupBy(*own).agg(F.count("*").alias("shared")).where(F.col("shared") >= 1 + F.floor(c / 20))
    return rows.join(enough.drop("shared"), own, "left_semi")


def _linked(task: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links within each (component, i, j); side 0 against side 1 where both are there, else all of side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key, ids, sides, sets, known):
            order = sorted(range(len(ids)), key=lambda x: sides[x])
            split = sides.count(0) if 1 in sides else 0
            for i, j in tree_links([sets[x] for x in order], split, num, den, [known[x] for x in order]):
                yield ids[order[i]], ids[order[j]]

        def frame(out):
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

        key, ids, sides, sets, known, out = None, [], [], [], [], []
        for batch in batches:
            for part in arrow_slices(batch, CHARS):
                s = shingle_sets(part["text"], k)
                keys = list(zip(part["component"], part["i"], part["j"], strict=True))
                for x, (doc, side, kn) in enumerate(zip(part["doc_id"], part["side"], part["known"], strict=True)):
                    if keys[x] != key:
                        out += found(key, ids, sides, sets, known)
                        key, ids, sides, sets, known = keys[x], [], [], [], []
                    if len(s[x]):
                        ids.append(doc), sides.append(side), sets.append(s[x]), known.append(kn)
                del s, part, keys
            del batch
            forget()
            if out:
                yield frame(out)
                out = []
        out += found(key, ids, sides, sets, known)
        del ids, sides, sets, known
        trim()
        yield frame(out)

    parts = int(task.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = task.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "doc_id")
    return near.mapInArrow(run, "a long, b long")


def _connecting(texts: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links that connect what is similar, within blocks and between them."""
    task = texts.select("component", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "doc_id", "text", F.col("doc_id").alias("known"))
    links = stored(_linked(task, k, num, den), "jaccard-links")
    if members.where("blocks > 1").limit(1).count():
        links = _across_blocks(texts, links, k, num, den)
    return links


def _counted(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows (a, b) of connecting links, and rows (digest, links) with a part of the links of a set.

    A block goes to the task of each pair of blocks that it is in: as side 0 with itself and all later ones, as side 1
    with all earlier ones. Two sets of similar size stand in the clusters of two size windows; their pair counts in
    the window of the smaller one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(key, rows, sets):
            at = sorted(range(len(rows)), key=lambda x: rows[x][1])
            split = sum(r[1] == 0 for r in rows) if key is not None and key[1] != key[2] else 0
            if split == len(rows):
                return [], []  # a pair of blocks with one side only
            weights, low = np.array([rows[x][3] for x in at], np.int64), np.array([rows[x][4] for x in at], bool)
            counts, links = tree_counts([sets[x] for x in at], split, num, den, weights, low)
            return [(rows[at[i]][0], rows[at[j]][0]) for i, j in links], [(rows[at[i]][2], int(counts[i])) for i in np.nonzero(counts)[0]]

        def frame(links, sums):
            return pd.DataFrame(
                {
                    "a": pd.array([x for x, _ in links] + [None] * len(sums), "Int64"), "b": pd.array([x for _, x in links] + [None] * len(sums), "Int64"),
                    "digest": [None] * len(links) + [x for x, _ in sums], "links": pd.array([None] * len(links) + [x for _, x in sums], "Int64"),
                }
            )

        key, rows, sets, links, sums = None, [], [], [], []
        for pdf in batches:
            for part in slices(pdf, CHARS):
                made = shingle_sets(part["text"], k)
                for r, s in zip(part.itertuples(index=False), made, strict=True):
                    if (r.component, r.i, r.j) != key:
                        more = found(key, rows, sets) if rows else ([], [])
                        links += more[0]
                        sums += more[1]
                        key, rows, sets = (r.component, r.i, r.j), [], []
                    # Other texts of the same doc_id, and repeated rows, have their own rows or none.
                    row = (r.doc_id, r.side, bytes(r.digest), r.copies, r.low)
                    if xxhash.xxh3_128_digest(s.tobytes()) == row[2] and not (rows and rows[-1] == row):
                        rows.append(row)
                        sets.append(s)
                del made
            if links or sums:
                yield frame(links, sums)
                links, sums = [], []
            trim()
        if rows:
            yield frame(*found(key, rows, sets))

    later = texts.withColumn("j", F.explode(F.expr("sequence(block, blocks - 1)"))).withColumns({"i": F.col("block"), "side": F.lit(0)})
    earlier = texts.where("block > 0").withColumn("i", F.explode(F.expr("sequence(0, block - 1)"))).withColumns({"j": F.col("block"), "side": F.lit(1)})
    task = later.unionByName(earlier).select("component", "i", "j", "side", "doc_id", "text", "digest", "copies", "low")
    parts = int(task.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = task.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "doc_id", "digest")
    return near.mapInPandas(run, "a long, b long, digest binary, links long")


def _across_blocks(texts: DataFrame, links: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Adds the links between blocks of large clusters.

    The largest connected part of a cluster needs no look at itself: only documents outside of it are
    compared, with all blocks. In a group of near copies they are few.
    """
    known = stored(components(links), "jaccard-known")
    known = known.select("node", F.col("component").alias("part"))
    big = texts.where("blocks > 1").join(known, F.col("doc_id") == F.col("node"), "left")
    big = big.select("doc_id", "text", "component", "block", "blocks", F.coalesce("part", "doc_id").alias("known"))
    sizes = big.groupBy("component", "known").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("component").agg(F.max(F.struct("size", "known")).alias("m")).select("component", F.col("m.known").alias("main"))
    big = stored(big.join(largest, "component"), "jaccard-big")
    minor = big.where("known <> main")
    has = minor.select(F.col("component").alias("c"), F.col("block").alias("mb")).distinct()
    left = minor.select("component", F.col("block").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), F.lit(0).alias("side"), "doc_id", "text", "known")
    right = big.join(has, F.col("component") == F.col("c")).select("component", F.col("mb").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "doc_id", "text", "known")
    more = stored(_linked(left.union(right), k, num, den), "jaccard-across")
    return links.union(more)
