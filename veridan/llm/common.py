"""What several corpus operators share: shared scratch tables, exact word shingles, components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import connected_components as components
from ..operators.tables import dropped, scratch, stored, stored_by  # noqa: F401


def kept_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names never meet ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# --- memory of Python workers -------------------------------------------------------------------


def trim() -> None:
    """Gives memory that is free back to the machine: executors run several Python workers beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(pdf: pd.DataFrame, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The rows in order, in pieces whose texts hold about ``chars`` characters (more only for one longer text)."""
    size = pdf["text"].str.len().fillna(0).cumsum() // chars
    for _, part in pdf.groupby(size, sort=True):
        yield part


def arrow_parts(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Like :func:`slices`, of an Arrow batch."""
    size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // chars)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def arrow_slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Like :func:`arrow_parts`; only one slice at a time is ever unpacked into Python's own strings."""
    for part in arrow_parts(batch, chars):
        yield part.to_pandas()


class Interned(dict):
    """key -> number in the order of first sight; a new key gets the next number."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs ``flat[start[i] : start[i] + size[i]]`` of all ``places`` i, one after another."""
    n = size[places]
    end = np.cumsum(n)
    return flat[np.repeat(start[places] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]


# --- words and shingles -------------------------------------------------------------------------


class WordHashes(dict):
    """word (bytes) -> 64-bit hash. It forgets all words when ``limit`` is reached, so memory is bounded."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def forget() -> None:
    """Empties the words' hashes and gives the memory back."""
    _HASHES.clear()
    trim()


#: Odd multipliers, one for each place in a shingle (made by a rule, so that any length works).
_PLACE = [int(xxhash.xxh3_64_intdigest(f"place {i}")) | 1 for i in range(64)]


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text: runs without ASCII white space, A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingle_sets(texts: Iterable[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``k``-word shingles.

    A text of fewer words counts as one shingle, the whole sequence; without words the set is empty.
    """
    out = []
    for text in texts:
        toks = words_of(text)
        n = len(toks)
        if n >= k:
            w = np.fromiter(map(_HASHES.__getitem__, toks), np.uint64, n)
            h = w[: n - k + 1] * np.uint64(_PLACE[0])
            for i in range(1, k):
                h += w[i : n - k + 1 + i] * np.uint64(_PLACE[i])
            h = _mixed(h)
            h.sort()
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(toks), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out
