"""WARC files: writing records, and reading them by boundary-chain verification.

Writing: one record a page; of equal payloads of at least ``SHARED`` bytes the page with the smallest
page_id is the response and the others revisit it. Spark's text sink writes the files: a row is a record
and the line separator is the record's end.

Reading: Spark's text source cuts the files at blank lines, in splits of any size. A task walks its
fragments in order and emits every place that looks like a record, with the place of its successor and the
digest of the payload it would have; it keeps digests, never payloads. Pointer jumping from the start of
each file then keeps the records that the chain reaches, in as many rounds as the logarithm of a file's
records; a record-like passage inside a payload is never reached. Payloads that cross splits are put
together from just the fragments they need.

Defined cases: null html: an empty payload. A null page_id is written without an id and comes back as
null; in a group of equal payloads it is a revisit. Rows that repeat the response's page_id and payload
are responses too. A null url has no target line; line breaks in it are dropped. Extra columns are ignored; an
empty table gives no records. A file whose last record is cut short keeps the records before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored

SHARED = 100
#: Splits with records that cross their ends whose fragments are fetched in one reading of the files.
CROSSING_AT_ONCE = 200_000
_END = "\r\n\r\n"


def write_warc(pages: DataFrame, path: str, shared: int = SHARED, compression: str = "none") -> None:
    """Write page_id, url, html as WARC 1.1 files below ``path``."""
    p = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    groups = p.select("page_id", "digest", "size").where(F.col("size") >= shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that its size is known when the join is planned: pages are shuffled only if many repeat.
    groups = stored(groups.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("g_digest"), "first"), "warc-groups")
    p = p.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("size") >= shared), "left")
    p = p.withColumn("refers", F.expr("if(first IS NOT NULL AND NOT page_id <=> first, first, null)"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.expr("if(refers IS NULL, 'response', 'revisit')"),
        F.coalesce(line("WARC-Record-ID", F.expr("concat('<urn:page:', page_id, '>')")), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.coalesce(line("WARC-Refers-To", F.expr("concat('<urn:page:', refers, '>')")), F.lit("")),
        F.expr("if(refers IS NULL, '', '\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest')"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.expr("if(refers IS NULL, size, 0)"),
        F.lit(_END),
        F.expr("if(refers IS NULL, html, '')"),
    )
    p.select(head.alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


# --- reading ------------------------------------------------------------------------------------


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """value (the bytes between blank lines), file, split; in the file's order within a split."""
    t = spark.read.option("lineSep", _END).text(path)
    return t.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _parsed(head: bytes) -> dict[str, str] | None:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    out = {}
    for x in lines[1:]:
        name, colon, value = x.partition(b":")
        if colon:
            out.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    return out if out.get("content-length", "").isdecimal() else None


_CANDIDATE = (
    "file string, split long, kind string, at long, length long, payload_at long, sha256 string, type string, "
    "record_id string, refers_to string, stated string"
)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate records (kind 'record'; sha256 null if the payload goes beyond the split) and splits' sizes."""
    key, pos, open_, out = None, 0, [], []

    def closed():
        for c in open_:
            out.append(c[0])
        open_.clear()
        if key is not None:
            out.append((*key, "split", 0, pos, 0, None, None, None, None, None))

    for pdf in batches:
        for value, file, split in zip(pdf["value"], pdf["file"], pdf["split"], strict=True):
            if (file, split) != key:
                closed()
                key, pos = (file, split), 0
            data = value + b"\r\n\r\n"
            still = []
            for c in open_:
                part = data[: c[1]]
                c[2].update(part)
                c[1] -= len(part)
                if c[1]:
                    still.append(c)
                else:
                    out.append((*c[0][:6], c[2].hexdigest(), *c[0][7:]))
            open_[:] = still
            lead = 2 if value.startswith(b"\r\nWARC/") else 0
            h = _parsed(value[lead:])
            if h is not None:
                length = int(h["content-length"])
                row = (file, split, "record", pos + lead, length, pos + len(data), None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-payload-digest"))
                if length:
                    open_.append([row, length, hashlib.sha256()])
                else:
                    out.append((*row[:6], hashlib.sha256().hexdigest(), *row[7:]))
            pos += len(data)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _CANDIDATE.split(", ")])
            out = []
    closed()
    if out:
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _CANDIDATE.split(", ")])


def _reached(candidates: DataFrame) -> DataFrame:
    """file, at of the records on the chain from the start of each file, by pointer jumping."""
    state = stored(candidates.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("on")), "warc-chain")
    while True:
        # Whatever a reached record's jump lands on is reached; then every jump is doubled.
        mark = state.where("on AND jump IS NOT NULL").select("file", F.col("jump").alias("at")).distinct()
        over = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("jump2"))
        new = state.join(mark.withColumn("hit", F.lit(True)), ["file", "at"], "left").join(over, ["file", "jump"], "left")
        new = stored(new.select("file", "at", F.col("jump2").alias("jump"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")), "warc-chain")
        dropped(state)
        state = new
        if not state.where("on AND jump IS NOT NULL").limit(1).count():
            return state.where("on").select("file", "at")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, at, length, sha256 (of the record's own payload), type, record_id, refers_to, stated of every true record."""
    fragments = _fragments(spark, path)
    walked = stored(fragments.mapInPandas(_walk, _CANDIDATE), "warc-walk")
    # Places of splits in their file: a row a split.
    splits = walked.where("kind = 'split'").select("file", "split", F.col("length").alias("size"))
    splits = splits.withColumn("base", F.expr("coalesce(sum(size) over (partition by file order by split rows between unbounded preceding and 1 preceding), 0)"))
    splits = stored(splits, "warc-splits")
    c = walked.where("kind = 'record'").join(splits.select("file", "split", "base"), ["file", "split"])
    c = c.select("file", (F.col("at") + F.col("base")).alias("at"), "length", (F.col("payload_at") + F.col("base")).alias("payload_at"), "sha256", "type", "record_id", "refers_to", "stated")
    c = stored(c.withColumn("next", F.expr("payload_at + length + 4")), "warc-candidates")
    true = c.join(_reached(c), ["file", "at"])
    crossing = true.where("sha256 IS NULL").select("file", "at", "payload_at", "length")
    return true.join(_crossing_digests(fragments, splits, crossing), ["file", "at"], "left").select(
        "file", "at", "length", F.coalesce("sha256", "joined").alias("sha256"), "type", "record_id", "refers_to", "stated"
    ).where("sha256 IS NOT NULL")


def _crossing_digests(fragments: DataFrame, splits: DataFrame, crossing: DataFrame) -> DataFrame:
    """file, at, joined: the digest of payloads that go beyond a split, from the fragments they overlap."""
    want = crossing.join(splits, "file").where("base < payload_at + length AND base + size > payload_at")
    want = want.groupBy("file", "split", "base").agg(F.min("payload_at").alias("since"), F.max(F.expr("payload_at + length")).alias("until"))
    want = stored(want.withColumnsRenamed({"file": "w_file", "split": "w_split"}), "warc-want")
    # The fragments must keep their order, so the wanted splits are broadcast, CROSSING_AT_ONCE of them at most; beyond
    # that the files are read once for each such part of them.
    passes = max(1, -(-want.count() // CROSSING_AT_ONCE))
    some = None
    for p in range(passes):
        part = want if passes == 1 else want.where(F.pmod(F.xxhash64("w_file", "w_split"), F.lit(passes)) == p)
        found = fragments.join(F.broadcast(part), (F.col("file") == F.col("w_file")) & (F.col("split") == F.col("w_split")))
        some = found if some is None else some.union(found)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pos = None, 0
        for pdf in batches:
            out = []
            for value, file, split, base, since, until in zip(*(pdf[x] for x in ("value", "file", "split", "base", "since", "until")), strict=True):
                if (file, split) != key:
                    key, pos = (file, split), base
                if pos < until and pos + len(value) + 4 > since:
                    out.append((file, pos, value + b"\r\n\r\n"))
                pos += len(value) + 4
            if out:
                yield pd.DataFrame(out, columns=["f_file", "pos", "bytes"])

    parts = some.select("value", "file", "split", "base", "since", "until").mapInPandas(place, "f_file string, pos long, bytes binary")
    parts = parts.join(crossing, (F.col("f_file") == F.col("file")) & F.expr("pos < payload_at + length AND pos + octet_length(bytes) > payload_at"))
    own = parts.groupBy("file", "at", "payload_at", "length").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("p"))
    whole = F.expr("aggregate(p, X'', (a, x) -> concat(a, x.bytes))")
    own = own.withColumn("whole", whole).where("octet_length(whole) >= payload_at - p[0].pos + length")
    return own.select("file", "at", F.sha2(F.expr("substring(whole, int(payload_at - p[0].pos) + 1, int(length))"), 256).alias("joined"))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that write_warc wrote."""
    r = stored(read_warc(spark, path), "warc-records")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    r = r.select(page(F.coalesce("record_id", F.lit(""))).alias("id"), page(F.coalesce("refers_to", F.lit(""))).alias("ref"), "length", "sha256", "type", "stated")
    r = r.selectExpr("try_cast(id as long) page_id", "try_cast(ref as long) refers_to", "length", "sha256", "type", "substring(stated, 8) stated")
    full = r.where("type = 'response'").groupBy(F.col("page_id").alias("full_id"), F.col("sha256").alias("full_sha")).agg(F.max("length").alias("full_length"))
    own = r.where("type = 'response'").select("page_id", F.col("length").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = r.where("type = 'revisit'").join(full, (F.col("refers_to") == F.col("full_id")) & (F.col("stated") == F.col("full_sha")))
    return own.union(again.select("page_id", "full_length", "full_sha", "type", "refers_to"))
