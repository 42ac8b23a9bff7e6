"""URL filters: glob rules packed into multiword Shift-And masks, all of them simulated at once over each canonical URL.

The canonical URL is a dot, the host with A-Z lower-cased, a border that is no character, and the path; query and fragment
are cut. A rule's glob runs over it: ``?`` is one character but ``/``, ``*`` any run without ``/``, ``**`` any
run at all, and none of them passes the border. A rule (host, path) fits its host, all subdomains and every path that it begins,
so its glob is ``*.`` + host, the border, path + ``**``; host and path may hold wildcards of their own.

Every place of a glob is a bit, a star lets the place before it stay. Globs lie one after another over as many 64-bit words
as they need, and a shift carries into the next word. One step takes the next byte of all URLs of a slice:
``D = (((D << 1) & B[c]) | (D & S[c]))``, with B the places that byte c enters and S those that it lets stay. A glob's first
place is set at the start alone and no byte enters it, so what a shift carries over from the glob before it dies. Globs lie in
order of preference, so the lowest set last place is the rule that holds. A URL leaves a slice as soon as only last places are
set, or none.

Rules are a list that a person keeps: they go to all tasks, so their masks are bounded (``MOST_BYTES``; beyond it an error).

Defined cases: a null URL or one without ``://`` has an empty host and path; no rule fits it. An empty path is not ``/``. Of
rules that fit, the longest text wins; of equally long ones the longer host, then a blocking one, then the first given. Repeated rows
and null ids give their own rows, extra columns are ignored, URLs of any length are walked whole, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, slices, trim

#: Most bytes of all masks together.
MOST_BYTES = 64 << 20
#: Characters of URLs, divided by the words of a mask, that are walked at once.
AT_ONCE = 4_000_000
#: Between host and path; no byte of UTF-8.
BORDER = b"\xff"
#: Steps after which URLs that can't change any more leave.
LOOK = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """allow or block; a host (with its subdomains); the beginning of a path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Masks:
    """``enter`` and ``stay``: 256 x words; the places set at the start and the last ones, and the last one's bit of each glob."""

    enter: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    last: np.ndarray
    ends: np.ndarray


def glob_places(host: str, path: str) -> list[tuple[str, bytes]]:
    """(what lets this place stay, the bytes that enter it) of every place of ``*.host`` and ``path**``."""
    places: list[list] = [["*", b""], ["", b"."]]
    for glob in (host, None, path + "**"):
        if glob is None:
            places.append(["", BORDER])
            continue
        for piece in re.findall(r"\*\*|[\s\S]", glob):
            if piece == "**":
                places[-1][0] = "**"
            elif piece == "*":
                places[-1][0] = "**" if places[-1][0] == "**" else "*"
            elif piece == "?":
                # The first byte of a character enters, further bytes of it let it stay.
                places.append(["tail", _ONE])
            else:
                places += [["", bytes([c])] for c in piece.encode("utf-8", "surrogatepass")]
    return [(stay, enter) for stay, enter in places]


_ONE = bytes(c for c in range(255) if c != 0x2F and not 0x80 <= c < 0xC0)
_STAY = {"": b"", "tail": bytes(range(0x80, 0xC0)), "*": bytes(c for c in range(255) if c != 0x2F), "**": bytes(range(255))}


def pack(globs: list[tuple[str, str]]) -> Masks:
    """Masks of all (host, path) globs, those first in the list at the lowest bits."""
    places = [glob_places(*g) for g in globs]
    bits = sum(map(len, places))
    words = max(1, -(-bits // 64))
    if 512 * 8 * words > MOST_BYTES:
        raise ValueError(f"rules of {bits} places need masks of {512 * 8 * words} bytes, more than {MOST_BYTES}")
    masks = Masks(np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64), np.zeros(len(globs), np.int64))
    bit = 0
    for i, own in enumerate(places):
        for j, (stay, enter) in enumerate(own):
            word, one = bit // 64, np.uint64(1 << bit % 64)
            masks.enter[list(enter), word] |= one
            masks.stay[list(_STAY[stay]), word] |= one
            if j == 0:
                masks.start[word] |= one
            if j == len(own) - 1:
                masks.last[word] |= one
                masks.ends[i] = bit
            bit += 1
    return masks


def matched(texts: list[bytes], masks: Masks) -> np.ndarray:
    """For each text the number of the first glob that matches it whole, -1 for none."""
    out = np.full(len(texts), -1, np.int64)
    if not texts or not len(masks.ends):
        return out
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    rows = np.argsort(-size, kind="stable")  # those that go on are always the first of these
    state = np.tile(masks.start, (len(rows), 1))
    final = np.zeros((len(texts), len(masks.start)), np.uint64)
    one, top, open_places = np.uint64(1), np.uint64(63), ~masks.last
    t = 0
    while len(rows):
        go = int(np.searchsorted(-size[rows], -t, side="left"))  # texts longer than t
        if go < len(rows):
            final[rows[go:]] = state[go:]
            rows, state = rows[:go], state[:go]
            continue
        c = flat[begin[rows] + t]
        shifted = state << one
        shifted[:, 1:] |= state[:, :-1] >> top
        state = (shifted & masks.enter[c]) | (state & masks.stay[c])
        t += 1
        if t % LOOK == 0:
            live = (state & open_places).any(axis=1)  # a last place, once set, stays: every glob ends in '**'
            if not live.all():
                final[rows[~live]] = state[~live]
                rows, state = rows[live], state[live]
    final &= masks.last
    hit = final.any(axis=1)
    word = (final != 0).argmax(axis=1)
    low = final[np.arange(len(final)), word]
    low &= ~low + one  # the lowest set bit alone
    bit = word * 64 + np.where(hit, np.log2(np.where(low == 0, one, low).astype(np.float64)).astype(np.int64), 0)
    out[hit] = np.searchsorted(masks.ends, bit[hit])
    return out


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict: the rule's, else ``default``."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    masks = pack([(r.host, r.path) for r in ranked])
    texts, verdicts = np.array([*[r.text for r in ranked], None], object), np.array([*[r.verdict for r in ranked], default], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf.assign(text=pdf["host"] + pdf["path"]), max(1, AT_ONCE // len(masks.start))):
                urls = [b"." + h.encode("utf-8", "surrogatepass") + BORDER + p.encode("utf-8", "surrogatepass") for h, p in zip(part["host"], part["path"], strict=True)]
                hit = matched(urls, masks)
                yield part[["page_id", "host", "path"]].astype({"page_id": "Int64"}).assign(rule=texts[hit], verdict=verdicts[hit])
            trim()

    host, path = host_and_path("url")
    cut = kept_columns(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    return cut.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")
