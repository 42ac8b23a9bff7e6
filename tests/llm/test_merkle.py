"""The manifest against a tree built level by level in plain Python, from the contract's words."""

import hashlib
import random
import zlib

import pytest

from veridan.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _tree(leaves):
    """Levels of a list of nodes, and each node's siblings as (left, right) of every level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])

    def siblings(i):
        out = []
        for level in levels[:-1]:
            a = i - i % 16
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
            i //= 16
        return out

    return levels[-1][0], siblings


def _brute(rows):
    by = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, _leaf(doc_id, source, lang, n_chars, text), doc_id, text, lang, n_chars))
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in groups:
        by[s].sort(key=lambda r: r[:3])
        trees[s] = _tree([r[2] for r in by[s]])
    root, above = _tree([trees[s][0] for s in groups])
    out = []
    for j, s in enumerate(groups):
        sub, beside = trees[s]
        for i, (_, _, leaf, doc_id, text, lang, n_chars) in enumerate(by[s]):
            way = beside(i) + above(j)
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = _leaf(doc_id, s, lang, n_chars, low) if bad else leaf
            for a, b in way:
                node = _h(a, node, b)
            out.append((doc_id, leaf, sub, root, _h(*[x for pair in way for x in pair]), node, node == root, len(way) if bad else 0))
    return sorted(out, key=str)


def _check(spark, rows, levels=merkle.LEVELS):
    m = merkle.manifest(spark.createDataFrame(rows, SCHEMA), levels)
    got = sorted((tuple(r) for r in merkle.proofs(m).collect()), key=str)
    assert got == _brute(rows)
    m.drop()
    return got


def test_against_a_plain_tree(spark):
    rng = random.Random(1)
    rows = []
    for source, n in ((None, 3), ("", 1), ("é", 16), ("hot", 700), ("b", 17), ("z", 257), *((f"s{i}", 1 + i % 3) for i in range(40))):
        rows += [(rng.randrange(2000), rng.choice([None, "", "Aé b", "plain", f"Text {i} ÀZ"]), rng.choice([None, "en"]), source, rng.choice([None, 0, 12]), "own", "own") for i in range(n)]
    rows += [rows[5], rows[5], (None, "T", "en", "hot", 1, "", ""), (None, None, None, None, None, None, None), (7, "Long " * 100_000, "en", "b", 9, "", "")]
    rng.shuffle(rows)
    got = _check(spark, rows)
    assert any(not r[6] for r in got) and sum(r[7] > 0 for r in got) > 100


def test_several_blocks(spark):
    """Blocks of 16 leaves: versions go on through five tables of blocks."""
    rows = [(i, f"T{i}", "en", "a" if i % 3 else f"s{i % 20}", i, "", "") for i in range(900)]
    got = _check(spark, rows, 1)
    assert max(r[7] for r in got) >= 4


@pytest.mark.parametrize("n", [4095, 4096, 4097])
def test_borders_of_a_block(spark, n):
    _check(spark, [(i, "A", None, "s", None, "", "") for i in range(n)])


def test_empty_and_single(spark):
    assert merkle.proofs(merkle.manifest(spark.createDataFrame([], SCHEMA))).count() == 0
    got = _check(spark, [(1, "X", "en", "s", 1, "", "")])
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == _h()
