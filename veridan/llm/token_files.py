"""Token-ID files: static range asymmetric numeral system (rANS) in independent interleaved blocks.

One frequency table, counted over all ids of the corpus and scaled to 2**20, is shared by all blocks. A
block holds whole documents, about ``BLOCK`` ids; its ids run through ``LANES`` interleaved coders with 64-bit
states that put out 32-bit words. Every ``CHECKPOINT`` rounds the states and the place in the word stream
are kept, so a reader can start there; a checksum of the words and one of the ids of each stretch between
checkpoints tell of damage. Files are Parquet as a container (Spark writes and finds them on any
store): ``data`` has a row a block, ``index`` the first id's place of each block, ``table`` the frequencies.

Documents stand in ascending order of doc_id: a range shuffle, sorted within tasks; places of blocks come
from two running sums (over a shard's blocks, over the shards' totals).

Defined cases: null text: no ids but the end id. Null doc_ids come first. Repeated doc_ids stand beside
each other, ordered by a hash of the text. An empty table gives files without rows. Extra columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Interned, arrow_parts, dropped, gathered, kept_columns, scratch, trim

SCALE_BITS, LANES, CHECKPOINT, BLOCK = 20, 4096, 64, 1 << 20
END_ID = 1
#: Characters of texts whose pieces are looked up at once.
AT_ONCE = 8_000_000
_LOW = np.uint64(1 << 32)


# --- coder --------------------------------------------------------------------------------------


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies in proportion to the counts, 1 at least where an id occurs, with the sum 2**bits."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    rest = size - int(f.sum())
    while rest:
        able = order[(f[order] > 1)] if rest < 0 else order[counts[order] > 0]
        take = able[: abs(rest)]
        f[take] += 1 if rest > 0 else -1
        rest = size - int(f.sum())
    return f


class Coder:
    def __init__(self, freq: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT, bits: int = SCALE_BITS):
        self.f = freq.astype(np.uint64)
        self.c = (np.cumsum(freq) - freq).astype(np.uint64)
        self.lanes, self.every, self.bits = lanes, every, np.uint64(bits)
        self.freq = freq

    def encode(self, ids: np.ndarray) -> dict:
        """words, states and word places at each checkpoint, checksums."""
        n, k = len(ids), self.lanes
        rounds = -(-n // k)
        x = np.full(k, _LOW, np.uint64)
        out, points = [], []
        wide, top = np.uint64(32), np.uint64(64) - self.bits
        count = 0
        for r in range(rounds - 1, -1, -1):
            s = ids[r * k : (r + 1) * k]
            m = len(s)
            f, y = self.f[s], x[:m]
            full = (y >> top) >= f
            if full.any():
                w = (y[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
                out.append(w)
                count += len(w)
                y = np.where(full, y >> wide, y)
            q = y // f
            x[:m] = (q << self.bits) + (y - q * f) + self.c[s]
            if r % self.every == 0:
                points.append((x.copy(), count))
        words = np.concatenate(out[::-1]) if out else np.empty(0, "<u4")
        points.reverse()
        return {
            "words": words.tobytes(),
            "states": np.concatenate([p for p, _ in points]).astype("<u8").tobytes() if points else b"",
            "places": [len(words) - c for _, c in points],
            "words_crc32": zlib.crc32(words.tobytes()),
            "ids_crc32": [zlib.crc32(ids[i : i + k * self.every].astype("<u4").tobytes()) for i in range(0, n, k * self.every)],
        }

    def decode(self, n: int, words: bytes, states: bytes, places: list[int], start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of the stretches ``start`` .. ``stop`` between checkpoints; all by default."""
        if not hasattr(self, "symbol"):
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        k = self.lanes
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        rounds = -(-n // k)
        first, last = start * self.every, min(rounds, (stop or len(places)) * self.every)
        if not places or last <= first:
            return np.empty(0, np.uint32)
        x = np.frombuffer(states, "<u8").reshape(len(places), k)[start].astype(np.uint64)
        at = places[start]
        mask, out = np.uint64((1 << int(self.bits)) - 1), []
        for r in range(first, last):
            m = min(k, n - r * k)
            y = x[:m]
            slot = y & mask
            s = self.symbol[slot]
            y = self.f[s] * (y >> self.bits) + slot - self.c[s]
            low = np.flatnonzero(y < _LOW)
            if len(low):
                y[low] = (y[low] << np.uint64(32)) | stream[at : at + len(low)]
                at += len(low)
            x[:m] = y
            out.append(s)
        return np.concatenate(out)


# --- tokens -------------------------------------------------------------------------------------

#: Letters and digits that stay what they are under NFC and lower-casing, alone and before any mark: after one of
#: them, and only there, the text is cut before punctuation without asking the tokenizer.
_PLAIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_TAIL = rf"([{_PLAIN}])([.,!?;:*&%$#|]+)(\s|$)"
#: Marks, which may make one letter with the letter before them (and what else shares their first byte in UTF-8).
_MARKS = "[\u0300-\u037f]"
#: Words that normalising and cutting leave as they are.
_LOWER = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Pieces:
    """Ids of white-space-delimited pieces by the tokenizers library, kept for the pieces in use.

    For a tokenizer that drops white space, and whose pre-tokens don't cross it, the ids of a text are those
    of its pieces. A tail of punctuation after a plain letter or digit is a pre-token of its own, so it is cut
    off. Texts are cut and their distinct pieces found by Arrow; each of them is looked up once a call, however
    often it occurs. Its ids stand in one array for all pieces. Words of plain letters are encoded by the model
    itself, other words of letters many at a time, as one text; each ends with a token that marks a word's end.
    """

    #: Pieces that are kept; beyond them all go that only one call used, and not the last one.
    limit = 800_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.as_bytes = {c: as_bytes(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.index = Interned()
        self.flat, self.start, self.size = np.empty(0, "<u2"), np.empty(0, np.int64), np.empty(0, np.int64)
        self.calls, self.used = np.empty(0, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        self.calls[self.used] += 1
        keys, keep = list(self.index), np.flatnonzero(self.calls > 1)
        self.index = Interned((keys[i], n) for n, i in enumerate(keep.tolist()))
        self.flat, self.size = gathered(self.flat, self.start, self.size, keep), self.size[keep]
        self.start, self.calls = np.cumsum(self.size) - self.size, np.zeros(len(keep), np.int64)

    def _added(self, ids: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> None:
        """The runs of ``ids`` as those of the pieces ``at``."""
        end = np.cumsum(lengths)
        self.start[at], self.size[at] = len(self.flat) + end - lengths, lengths
        self.flat = np.concatenate([self.flat, ids])

    def _together(self, words: list[str], at: np.ndarray) -> list[int]:
        """Encodes words of letters as one text each 20,000; places in ``words`` of those for which that didn't do."""
        left = []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self._added(ids, at[i : i + 20_000], np.diff(ends, prepend=0))
            else:
                left += range(i, i + len(part))
        return left

    def _one_by_one(self, words: list[str], at: np.ndarray) -> None:
        """Encodes words that normalising and cutting leave as they are by the model itself."""
        ids, sizes = [], []
        for w in words:
            own = self.model.tokenize(w if w.isascii() else w.translate(self.as_bytes))
            ids += [t.id for t in own]
            sizes.append(len(own))
        self._added(np.array(ids, "<u2"), at, np.array(sizes, np.int64))

    def _learn(self, new: list[bytes], known: int) -> None:
        words, more = b"\n".join(new).decode().split("\n"), np.zeros(len(new), np.int64)
        self.start, self.size, self.calls = (np.concatenate([x, more]) for x in (self.start, self.size, self.calls))
        lower, plain, rest = [], [], []
        for i, w in enumerate(words):
            (lower if _LOWER.fullmatch(w) else plain if w.isalpha() else rest).append(i)
        self._one_by_one([words[i] for i in lower], np.array(lower, np.int64) + known)
        left = self._together([words[i] for i in plain], np.array(plain, np.int64) + known)
        rest += [plain[i] for i in left]
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            every = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False)]
            self._added(np.array([x for own in every for x in own], "<u2"), np.array(part, np.int64) + known, np.array(list(map(len, every)), np.int64))

    @staticmethod
    def _split(texts: pa.Array) -> pa.Array:
        """The pieces of each text."""
        texts = pc.if_else(pc.match_substring_regex(texts, _MARKS), texts, pc.ascii_lower(texts))
        return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, pattern=_TAIL, replacement=r"\1 \2\3"))

    def ids(self, texts: pa.Array | list[str | None], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end`` after them if given."""
        if len(self.index) > self.limit:
            self._forget()
        split = self._split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = len(self.index)
        self.used = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        fresh = np.flatnonzero(self.used >= known).tolist()  # numbered in this order
        if fresh:
            self._learn([pieces[i] for i in fresh], known)
        self.calls[self.used] += 1
        size = self.size[self.used]
        flat, places = gathered(self.flat, self.start, self.size, self.used), coded.indices.to_numpy()
        every = gathered(flat, np.cumsum(size) - size, size, places)
        count = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size[places])])[np.cumsum(np.concatenate([[0], count]))]
        if end is not None:
            every = np.insert(every, ends[1:], end)
            ends = ends + np.arange(len(ends))
        at = ends.tolist()
        return [every[a:b] for a, b in zip(at, at[1:], strict=False)]


_PIECES: dict[str, Pieces] = {}


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """shard, block, doc_ids, lengths, ids: blocks of whole documents in ascending order of doc_id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = kept_columns(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    own = own.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _PIECES:
            _PIECES[tokenizer] = Pieces(tokenizer)
        pieces = _PIECES[tokenizer]
        shard, no, names, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            lengths, data = [len(i) for i in ids], np.concatenate(ids).astype("<u2").tobytes()
            kinds = {"shard": pa.int32(), "block": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, no, names, lengths, data), kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            for part in arrow_parts(batch, AT_ONCE):
                for name, own_ids in zip(part["doc_id"].cast(pa.int64()).to_pylist(), pieces.ids(part["text"], end_id), strict=True):
                    names.append(name)
                    ids.append(own_ids)
                    size += len(own_ids)
                    if size >= block:
                        yield row()
                        no, names, ids, size = no + 1, [], [], 0
            trim()
        if names:
            yield row()

    return own.mapInArrow(run, "shard int, block int, doc_ids array<long>, lengths array<int>, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, vocabulary: int = 1 << 16, end_id: int = END_ID) -> None:
    """Tokenize, count, encode; ``vocabulary`` (at most 65,536) bounds the ids."""
    spark = docs.sparkSession
    target = scratch(spark, "token-blocks")
    token_blocks(docs, tokenizer, end_id).write.parquet(target)
    blocks = spark.read.schema("shard int, block int, doc_ids array<long>, lengths array<int>, ids binary").parquet(target)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for pdf in batches:
            for b in pdf["ids"]:
                total += np.bincount(np.frombuffer(b, "<u2"), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    # As many rows as the vocabulary has ids, whatever the corpus.
    table = blocks.select("ids").mapInPandas(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[table["id"].to_numpy(np.int64)] = table["n"].to_numpy()
    freq = scaled(counts)
    at = np.flatnonzero(freq)
    spark.createDataFrame(pd.DataFrame({"id": at.astype(np.int32), "freq": freq[at]}), "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    held = spark.sparkContext.broadcast(freq)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(held.value)
        for pdf in batches:
            coded = [coder.encode(np.frombuffer(b, "<u2").astype(np.int64)) for b in pdf["ids"]]
            out = pdf.drop(columns="ids")
            for c in ("words", "states", "places", "words_crc32", "ids_crc32"):
                out[c] = [x[c] for x in coded]
            yield out

    schema = "shard int, block int, doc_ids array<long>, lengths array<int>, words binary, states binary, places array<int>, words_crc32 long, ids_crc32 array<long>"
    blocks.mapInPandas(encode, schema).write.option("compression", "none").parquet(f"{path}/data")  # coded words don't get smaller
    sizes = spark.read.parquet(f"{path}/data").select("shard", "block", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n_ids"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # a row a shard: small enough for one window
    shards = shards.select("shard", F.expr("coalesce(sum(total) over (order by shard rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    within = "coalesce(sum(n_ids) over (partition by shard order by block rows between unbounded preceding and 1 preceding), 0)"
    index = sizes.withColumn("inside", F.expr(within)).join(shards, "shard").select("shard", "block", "n_ids", (F.col("before") + F.col("inside")).alias("start"))
    index.write.parquet(f"{path}/index")
    dropped(blocks)


def _opened(spark: SparkSession, path: str):
    """A function that takes batches of ``data`` rows and gives (row, lengths, ids), checked and decoded."""
    table = spark.read.parquet(f"{path}/table").toPandas()  # bounded by the vocabulary
    freq = np.zeros(1 << 16, np.int64)
    freq[table["id"].to_numpy(np.int64)] = table["freq"].to_numpy()
    held = spark.sparkContext.broadcast(freq)

    def blocks(batches: Iterator[pd.DataFrame]):
        coder, step = Coder(held.value), LANES * CHECKPOINT
        for pdf in batches:
            for r in pdf.itertuples():
                if zlib.crc32(r.words) != r.words_crc32:
                    raise ValueError(f"shard {r.shard}, block {r.block}: damaged words")
                lengths = np.asarray(r.lengths, np.int64)
                ids = coder.decode(int(lengths.sum()), r.words, r.states, list(r.places))
                if [zlib.crc32(ids[i : i + step].astype("<u4").tobytes()) for i in range(0, len(ids), step)] != list(r.ids_crc32):
                    raise ValueError(f"shard {r.shard}, block {r.block}: ids don't match their checksum")
                yield r, lengths, ids.astype("<u4", copy=False)

    return blocks


def _per_document(spark: SparkSession, path: str, name: str, kind: str, value) -> DataFrame:
    """doc_id, start, n_tokens and ``value`` of each document's ids."""
    blocks = _opened(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, lengths, ids in blocks(batches):
            end = np.cumsum(lengths)
            own = [value(ids[b - n : b]) for n, b in zip(lengths.tolist(), end.tolist(), strict=True)]
            yield pd.DataFrame({"shard": r.shard, "block": r.block, "doc_id": pd.array(list(r.doc_ids), "Int64"), "offset": end - lengths, "n_tokens": lengths, name: own})

    docs = spark.read.parquet(f"{path}/data").mapInPandas(run, f"shard int, block int, doc_id long, offset long, n_tokens long, {name} {kind}")
    index = spark.read.parquet(f"{path}/index").select("shard", "block", "start")
    return docs.join(index, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", name)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, decoded and held against the checksums."""
    return _per_document(spark, path, "ids", "array<int>", lambda ids: ids.astype(np.int32))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return _per_document(spark, path, "ids_crc32", "long", lambda ids: zlib.crc32(ids.tobytes()))
