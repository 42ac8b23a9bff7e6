"""Merkle manifest of a dataset as a persistent tree: versions share what they don't change and copy only a path.

Rows are leaves. Each group of rows (a source) is a tree of 16-fold nodes over its leaves in order; the group's
roots, in order of the groups, are the leaves of one more tree, whose root names the dataset. Nodes lie in aligned blocks of
4,096 consecutive ones of a level (16 ** LEVELS): a block is one row of a table, and its three levels of ancestors are made in one
place. Blocks' roots are the nodes of the next table, and so on up: few rounds, each 4,096 times smaller than the last.

A changed leaf makes a version of the tree. In its block it copies the ancestors on its path, at most three, and shares every
other node with the first version (:class:`Block`, :func:`Block.path`). Where the block ends, the version goes on in
the block above: what it needs of all the upper blocks are the neighbours of its path, and these are the same for all
leaves of a block. They are handed down from the top, level by level, and joined to each block once, so versions never
meet in one place and no version builds a tree.

Ranks in a group come from ranges of rows (``operators.scan``), so a group may hold any share of the rows.

Defined cases: nulls are leaves like others (a null field is written ``-``; null ids first, a null group first). Rows with the
same id are leaves of their own, in order of their digests. Empty texts count 0 bytes. A group of one row has that leaf
as its root. An empty table gives no rows. Extra columns are ignored. A row without an id is never tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import null_safe, ranked
from .common import dropped, kept_columns, stored, trim

FAN = 16
#: Levels of ancestors in one aligned block of FAN ** LEVELS consecutive nodes.
LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The leaf of a row of documents; some fields from other columns."""
    return F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the tampered leaf of the rows whose id's crc32 5 divides (else null)."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(text=F.translate("text", _UPPER, _LOWER)))
    return kept_columns(docs, *FIELDS).select("doc_id", F.col("source").alias("grp"), leaf().alias("leaf"), changed.alias("tampered"))


class Block:
    """The nodes of one aligned block, level by level from its own to its root. Nothing in it ever changes."""

    def __init__(self, nodes: list[str], n: int, levels: int = LEVELS):
        """``n``: nodes of the group. If it has no other block, the levels end where one node remains."""
        self.levels = [nodes]
        while len(self.levels) <= levels and not (n <= FAN**levels and len(self.levels[-1]) == 1):
            low = self.levels[-1]
            self.levels.append([digest(*low[i : i + FAN]) for i in range(0, len(low), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def beside(self, at: int) -> list[tuple[str, str]]:
        """(left, right): the digests of the other nodes of each run on the path of node ``at``."""
        out = []
        for low in self.levels[:-1]:
            first = at // FAN * FAN
            out.append(("".join(low[first:at]), "".join(low[at + 1 : first + FAN])))
            at //= FAN
        return out


def path(node: str, beside: list[tuple[str, str]]) -> list[str]:
    """A version: the copied ancestors of a changed node, from the lowest to the last; all others are shared."""
    out = []
    for left, right in beside:
        node = digest(left, node, right)
        out.append(node)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: a block's row is large, so only one is ever unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        trim()


def _blocks(nodes: DataFrame, name: str, extra: list[str], levels: int) -> DataFrame:
    """A row a block of (grp, _rank, _total, h): its members in order (with ``extra``), and its root; a table."""
    own = nodes.groupBy("grp", F.expr(f"_rank div {FAN**levels}").alias("block")).agg(
        F.first("_total").alias("n"), F.array_sort(F.collect_list(F.struct("_rank", "h", *extra))).alias("m")
    )
    own = own.select("grp", "block", "n", *[F.expr(f"transform(m, x -> x.{e})").alias(e) for e in ("h", *extra)])
    kinds = ", ".join(f"{n} {t}" for n, t in own.dtypes)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = [Block(r["h"], r["n"], levels).root for r in _rows([batch.select(["n", "h"])])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(root, pa.string())], [*batch.schema.names, "root"])

    return stored(own.mapInArrow(roots, f"{kinds}, root string"), name)


def _raised(low: DataFrame, levels: int) -> DataFrame:
    """The blocks' roots as the nodes of the next level."""
    return low.select("grp", F.col("block").alias("_rank"), F.ceil(F.col("n") / FAN**levels).alias("_total"), F.col("root").alias("h"))


_ABOVE = "array<struct<left: string, right: string>>"
_DOWN = pa.schema([
    ("grp", pa.string()), ("block", pa.int64()), ("above", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string()), ("top", pa.string()),
])


def _handed_down(told: DataFrame, levels: int) -> DataFrame:
    """What the blocks below ``told`` need: ``above``, the neighbours of each one's way to the root, its group's root, and the root."""
    named = "name" in told.columns

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            own, n = Block(r["h"], r["n"], levels), len(r["h"])
            # Below the tree of the groups' roots each node is the only block of the group that it names.
            grp, block = (r["name"], [0] * n) if named else ([r["grp"]] * n, [r["block"] * FAN**levels + i for i in range(n)])
            above = [[{"left": a, "right": b} for a, b in own.beside(i)] + r["above"] for i in range(n)]
            columns = [grp, block, above, r["h"] if named else [r["subroot"]] * n, [r["top"]] * n]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _DOWN.types, strict=True)], schema=_DOWN)

    return told.drop("root").mapInArrow(down, f"grp string, block long, above {_ABOVE}, subroot string, top string")


def _told(low: DataFrame, down: DataFrame) -> DataFrame:
    """Blocks with what is handed down to each."""
    down = down.withColumnsRenamed({"grp": "_k_grp", "block": "_b"})
    return low.join(down, null_safe(["grp"], "_k_") & (F.col("block") == F.col("_b"))).drop("_k_grp", "_b")


class Manifest:
    """The tree as tables of blocks: the first one holds the leaves, the last one the root of all."""

    def __init__(self, rows: DataFrame, levels: int = LEVELS):
        """``rows``: doc_id, grp, leaf, tampered; ``levels``: those of a block."""
        self.levels = levels
        placed = ranked(rows.withColumnRenamed("leaf", "h"), ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("h")], "merkle-ranks")
        self.tables = [_blocks(placed, "merkle-leaves", ["doc_id", "tampered"], levels)]
        dropped(placed)
        self._raise()
        # The groups' roots, in order of the groups, are the leaves of the tree above.
        names = self.tables[-1].select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("h"))
        top = ranked(names, ["grp"], [F.col("name").asc_nulls_first()], "merkle-groups")
        self.tables.append(_blocks(top, "merkle-nodes", ["name"], levels))
        dropped(top)
        self._raise()

    def _raise(self) -> None:
        while not self.tables[-1].where(F.col("n") > FAN**self.levels).isEmpty():
            self.tables.append(_blocks(_raised(self.tables[-1], self.levels), "merkle-nodes", [], self.levels))

    def told(self) -> DataFrame:
        """The blocks of leaves, each with the neighbours of its way up to the root of all (``above``), its group's root, and that root."""
        last = self.tables[-1]
        told = last.withColumns({"above": F.expr(f"cast(array() AS {_ABOVE})"), "subroot": F.lit(None).cast("string"), "top": F.col("root")})
        for low in reversed(self.tables[:-1]):
            told = _told(low, _handed_down(told, self.levels))
        return told

    def drop(self) -> None:
        dropped(*self.tables)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()),
    ("verified", pa.bool_()), ("nodes_copied", pa.int64()),
])


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, nodes_copied of every leaf.

    ``folded_root`` is the root of the leaf's own version (where it is tampered with) or, folded from its proof, of the
    first one; ``nodes_copied`` how many nodes that version does not share (0 without one).
    """

    levels = manifest.levels

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            own = Block(r["h"], r["n"], levels)
            above = [(x["left"], x["right"]) for x in r["above"]]
            rest = "".join(a + b for a, b in above)
            ways = [own.beside(i) for i in range(len(r["h"]))]
            # In the block each version copies its own path; the untouched leaves of a block meet in the root that it has.
            once = path(own.root, above)
            tops, copied = [], []
            for h, new, way in zip(r["h"], r["tampered"], ways, strict=True):
                version = [new or h, *path(new or h, way)]
                version += once if version[-1] == own.root else path(version[-1], above)
                tops.append(version[-1])
                copied.append(0 if new is None else len(version) - 1)
            n = len(tops)
            columns = [
                r["doc_id"], r["h"], [r["subroot"]] * n, [r["top"]] * n, [digest(*[x for pair in way for x in pair], rest) for way in ways], tops,
                [t == r["top"] for t in tops], copied,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)

    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, nodes_copied long"
    return manifest.told().drop("root").mapInArrow(each, kinds)


def manifest(docs: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of a table of documents, a tree for each source."""
    return Manifest(leaves(docs), levels)
