"""What op7 leaves on disk, and the numbers by which its documents keep their words."""

import base64
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from veridan.llm import bpe
from veridan.llm import queries as corpus


@pytest.fixture(scope="module")
def tokens():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _shuffled(spark):
    """The shuffle files there are: name -> bytes."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


def _written(path):
    return sum(os.path.getsize(os.path.join(folder, x)) for folder, _, names in os.walk(path) for x in names)


def _wanted(tokens, text):
    ids = tokens.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_tables_and_shuffles_stay_within_the_disk_budget(spark, sf, tokens):
    sf = sf.replace("sf0.001", "sf0.1")
    base, before = spark.conf.get("spark.checkpoint.dir"), _shuffled(spark)
    there = _written(base)
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus.op7_byte_bpe(spark, sf).collect()}
    disk = _written(base) - there + sum(n for name, n in _shuffled(spark).items() if name not in before)
    assert disk < 1.5 * os.path.getsize(f"{sf}/documents.parquet")
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert got.keys() == texts.keys()
    assert all(got[k] == _wanted(tokens, t) for k, t in texts.items() if zlib.crc32(str(k).encode()) % 20 == 0)


def test_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"the word{i} and another one") for i in range(200)], "doc_id long, text string")
    plan = bpe.token_digests(docs)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 2 and "FlatMapCoGroupsInArrow" in plan


def test_more_words_than_two_bytes_number(spark, tokens):
    texts = [" ".join(f"w{i:x}q" for i in range(a, a + 40_000)) for a in (0, 35_000)] + ["w1q w1q w9999q", "", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.token_digests(docs).collect()}
    assert got == {i: _wanted(tokens, t) for i, t in enumerate(texts)}


def test_numbers_and_packed_strings_come_back():
    for kind, most in (("<u2", 65536), ("<u4", 1 << 32)):
        for n in (0, 1, 2, 1000):
            x = np.random.default_rng(n).integers(0, most, n)
            assert (bpe._numbers(bpe._planes(x.astype(kind)), kind) == x).all()
    c, d = bpe.zstandard.ZstdCompressor(level=3), bpe.zstandard.ZstdDecompressor()
    for items in ([], [b""], [b"a", b"", b"\0" * 70_000, b"b"]):
        assert bpe._unpack(d, bpe._pack(c, items)) == items
    assert bpe._dealt(np.array([0, 2, 3, 0, 1])).tolist() == [0, 2, 5, 1, 3, 4]
    assert not bpe._dealt(np.array([], np.int64)).size
