"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

A word is one match of the pre-token pattern. Texts are cut into words once, in blocks of bounded size: a block
keeps for each document the numbers of its words in order (its positions), and emits every distinct word it holds
once, with its number, to the shuffle's bucket of the word; rows are packed, one for each block and bucket. In its
bucket each distinct word is encoded once, whichever blocks ask. The ids are joined back to the blocks, where each
document's ids are put together by position. Neither texts nor positions are ever shuffled. Decoding joins the table of
token bytes by id; the table is as large as the vocabulary, never as the data, and goes to all tasks.

The cut texts are a table written in buckets by block: block numbers stay what they are when a task runs again, and the
positions are read where the ids of their block arrive. A block numbers the most frequent words of all buckets first,
then the second ones and so on, so numbers are small and no order needs to be stored.

Defined cases: a null text counts as empty, without ids. Extra columns pass through encode() as long as
they are not called ``ids``, which is replaced; the text itself can be had back by decode(). Repeated rows give repeated
results. White space, whatever its kind or length, is encoded like any other text, so decoding returns the exact bytes.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Interned, gathered, stored_by, trim

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text in a block, about; documents whose words are cut at once; buckets for each shuffle partition.
BLOCK_CHARS, AT_ONCE, SPREAD = 10_000_000, 500, 4
#: Words whose ids a task keeps while it works on a bucket.
KEPT_WORDS = 1_000_000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters, and neighbours, for which the quick split below doesn't hold.
_ODD = re.compile("[\\x00\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_ODD_PAIRS = ("  ", "\n\n", "\n ", " \n")


@lru_cache(2)
def _pattern() -> regex.Pattern:
    """The public pattern, with white space spelled out so that it is Unicode's own set."""
    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def pieces(text: str) -> list[str]:
    """Cuts the text where the pattern surely cuts it too: quick, and the pieces repeat often."""
    if not text:
        return []
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD_PAIRS) or _ODD.search(text):
        return _pattern().findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def piece_words(piece: str) -> list[str]:
    """The pattern's matches in a piece; most pieces are one word of letters."""
    return [piece] if (piece[1:] if piece[0] == " " else piece).isalpha() else _pattern().findall(piece)


def _planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on: the higher ones are mostly zero and compress well."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    """The numbers, as 64-bit ones, whose planes these are."""
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel().astype(np.int64)


def _pack(c: zstandard.ZstdCompressor, items: list[bytes]) -> bytes:
    """Byte strings as one: count and lengths, then all bytes, compressed."""
    n = len(items)
    return c.compress(n.to_bytes(4, "little") + _planes(np.fromiter(map(len, items), "<u4", n)) + b"".join(items))


def _opened(d: zstandard.ZstdDecompressor, packed: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes of packed strings."""
    data = d.decompress(packed)
    n = int.from_bytes(data[:4], "little")
    return _numbers(data[4 : 4 * (n + 1)], "<u4"), data[4 * (n + 1) :]


def _unpack(d: zstandard.ZstdDecompressor, packed: bytes) -> list[bytes]:
    size, data = _opened(d, packed)
    end = np.cumsum(size)
    return [data[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]


def _dealt(count: np.ndarray) -> np.ndarray:
    """Where the words of a block stand, by number, when buckets of ``count`` words follow each other: first words first."""
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.argsort(place, kind="stable")


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``ids`` (array<int>): the ids of the whole text."""
    return _encoded(docs, ranks, "ids array<int>", lambda ids: {"ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))})


class _Block:
    """Documents cut into pieces, until they are enough for a block."""

    def __init__(self):
        self.number, self.held, self.places, self.chars = Interned(), [], [], 0

    def add(self, rest: pa.RecordBatch, texts: list[str | None]) -> None:
        number = self.number.__getitem__
        for t in texts:
            own = pieces(t) if t else []
            self.places.append(np.fromiter(map(number, own), np.int64, len(own)))
            self.chars += len(t or "")
        self.held.append(rest)

    def words(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, how often they stand here, and as runs of word numbers the words of each piece."""
        number, runs, sizes = Interned(), [], []
        for p in self.number:
            own = piece_words(p)
            sizes.append(len(own))
            runs += [number[w] for w in own]
        size, run = np.array(sizes, np.int64), np.array(runs, np.int64)
        often = np.zeros(len(sizes), np.int64)
        for p in self.places:
            np.add.at(often, p, 1)
        often = np.bincount(run, np.repeat(often, size), len(number))
        return [w.encode("utf-8", "surrogatepass") for w in number], often, run, np.cumsum(size) - size, size


def _cut(schema: T.StructType, text: str, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of documents to two kinds of rows: a document with its word numbers, or a block's words of one bucket."""
    rest = [f.name for f in schema.fields if f.name != text]

    def closed(block: _Block, name: int, c: zstandard.ZstdCompressor, kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        words, often, runs, start, size = block.words()
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.lexsort((-often, bucket))
        found, count = np.unique(bucket, return_counts=True)
        number = np.empty(len(words), np.int64)
        number[order[_dealt(count)]] = np.arange(len(words))
        kind = "<u2" if len(words) <= 65536 else "<u4"
        seqs = [c.compress(_planes((number[gathered(runs, start, size, p)] if len(words) else p).astype(kind))) for p in block.places]
        at = 0
        for batch in block.held:
            n = batch.num_rows
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([name] * n, pa.int64()), pa.array(seqs[at : at + n], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], [*rest, "block", "seq", "bucket", "words"]
            )
            at += n
        end = np.cumsum(count)
        packed = [_pack(c, [words[i] for i in order[a:b].tolist()]) for a, b in zip((end - count).tolist(), end.tolist(), strict=True)]
        n = len(packed)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(n, kinds[r]) for r in rest], pa.array([name] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(found, pa.int32()), pa.array(packed, pa.binary())], [*rest, "block", "seq", "bucket", "words"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, block, c, kinds = TaskContext.get().partitionId(), 0, _Block(), zstandard.ZstdCompressor(level=3), {}
        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                block.add(some.select(rest), some.column(text).to_pylist())
                if block.chars >= BLOCK_CHARS:
                    yield from closed(block, (task << 32) + no, c, kinds)
                    no, block = no + 1, _Block()
                    trim()
        if block.held:
            yield from closed(block, (task << 32) + no, c, kinds)
            trim()

    return run


def _encoded(docs: DataFrame, ranks: str | None, kind_of: str, finish: Callable[[list[np.ndarray]], dict[str, pa.Array]]) -> DataFrame:
    """``docs`` without ``text``, with the columns that ``finish`` makes of the ids where a block is put together."""
    path = ranks or public_tokenizers.path(RANKS)
    spark = docs.sparkSession
    made = T.StructType.fromDDL(kind_of)
    cols = [c for c in docs.columns if c not in made.names]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols]).toDF(*[f"c{i}" for i in range(len(cols))])
    text = f"c{cols.index('text')}"
    rest = [c for c in docs.columns if c != text]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.dtype("<u2" if len(_ranks(path)) <= 65536 else "<u4")
    own = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name in rest]
    cut_schema = T.StructType([*own, *T.StructType.fromDDL("block long, seq binary, bucket int, words binary").fields])
    cut = stored_by(docs.mapInArrow(_cut(docs.schema, text, parts * SPREAD), cut_schema), "bpe-blocks", "block")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, done, c, d = None, {}, zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        single = _encoding(path)._encode_single_piece
        for pdf in batches:
            out = []
            for k, packed_words in zip(pdf["bucket"], pdf["words"], strict=True):
                if k != bucket or len(done) > KEPT_WORDS:
                    bucket, done = k, {}
                ws = _unpack(d, packed_words)
                for w in ws:
                    if w not in done:
                        done[w] = np.array(single(w), kind).tobytes()
                out.append(_pack(c, [done[w] for w in ws]))
            yield pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "ids": out})

    words = cut.where("bucket IS NOT NULL").select("block", "bucket", "words").repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    words = words.mapInPandas(encoded, "block long, bucket int, ids binary")

    def assembled(held: pa.Table, table: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        table = table.sort_by("bucket")
        sizes, flats = [np.empty(0, np.int64)], [np.empty(0, kind)]
        for packed_ids in table.column("ids").to_pylist():
            size, data = _opened(d, packed_ids)
            sizes.append(size // kind.itemsize)
            flats.append(np.frombuffer(data, kind))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        at = _dealt(np.array([len(s) for s in sizes]))
        start, size, wide = (np.cumsum(size) - size)[at], size[at], "<u2" if len(size) <= 65536 else "<u4"
        columns = []
        for i in range(0, held.num_rows, AT_ONCE):
            seqs = [_numbers(d.decompress(s), wide) for s in held.column("seq").slice(i, AT_ONCE).to_pylist()]
            columns.append(finish([gathered(flat, start, size, s) for s in seqs]))
        out = held.select(rest)
        for name in made.names:
            out = out.append_column(name, pa.chunked_array([c[name] for c in columns]))
        trim()
        return out

    out = cut.where("bucket IS NULL").select(*rest, "block", "seq").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assembled, T.StructType([*own, *made.fields]))
    return out.toDF(*[cols[int(c[1:])] for c in rest], *made.names)


@lru_cache(2)
def _token_bytes(path: str) -> list[bytes]:
    """The table of token bytes, by id."""
    out = [b""] * (max(_ranks(path).values()) + 1)
    for b, i in _ranks(path).items():
        out[i] = b
    return out


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the tokens in ``ids``, in order."""
    path = ranks or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = _token_bytes(path).__getitem__
        for s in batches:
            yield pd.Series([None if ids is None else b"".join(map(token, ids.tolist())) for ids in s], dtype=object)

    return encoded.withColumn("decoded", joined("ids"))


@lru_cache(2)
def _decimals(path: str) -> list[bytes]:
    return [str(i).encode() for i in range(len(_token_bytes(path)))]


def token_digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts encoded, the ids decoded, both digested in place.

    The same steps as ``decode(encode(docs))``, without moving the ids themselves once more.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def finish(ids: list[np.ndarray]) -> dict[str, pa.Array]:
        token, decimal = _token_bytes(path).__getitem__, _decimals(path).__getitem__
        listed = [i.tolist() for i in ids]
        return {
            "n_tokens": pa.array([len(i) for i in listed], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(b",".join(map(decimal, i))).hexdigest() for i in listed], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(b"".join(map(token, i))).hexdigest() for i in listed], pa.string()),
        }

    return _encoded(docs.select("doc_id", "text"), ranks, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)
