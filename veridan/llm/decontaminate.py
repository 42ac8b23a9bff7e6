"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A word is a run of letters and digits, lower-cased, and stands as its 64-bit hash. A seed hashes the
words at a mask's chosen places and ignores the others, so a substituted word spoils few seeds. Seeds of
the benchmark are joined with the seeds of every document. Around each hit the item and the document are
laid side by side; the pair counts if a window of ``WINDOW`` words (the whole item if it is shorter) about
the hit agrees in at least ``AGREE`` of its places.

Documents are read once and never shuffled as a whole. Their positions are tested in one compiled step against a bitmap of
bounded size, made from the benchmark's seeds; only those whose seed may occur leave that step, each with the
bounded stretch of words that verification needs. A seed's row is its hash, item and position; up to
``SEEDS_AT_ONCE`` of them, counted first, are broadcast, more are joined by a shuffle of the picked positions. The items'
words join the hits by item, in stretches about a position of the same bounded length, and only (document, item)
pairs are aggregated.

Defined cases: null or word-less texts have no hits. Items under ``MIN_WORDS`` words take no part (a few
common words prove nothing); items under 12 words get further seeds by their length (``SHORT_MASKS``), so that
whatever the rule lets differ, a seed hits. Repeated documents
or items each give their own pairs; a repeated (doc_id, item_id) gives one. Null ids never match.
Windows don't reach over a document's ends: an item cut off there must still fill a whole window. Other
columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts, 0: it may be anything. Of 20 words with any four substituted, one of these always hits.
MASKS = ("1101101", "110010101", "1010001101")
WINDOW, AGREE, MIN_WORDS = 20, 0.8, 5
#: By an item's words: the masks it needs besides, where those above miss some of what AGREE lets differ.
SHORT_MASKS = {5: ("1111", "11011", "10111", "11101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("11011",), 10: ("11011",), 11: ("11011",)}
#: Seeds (some 50 bytes each), and stretches of items (some 500), that are broadcast at most.
SEEDS_AT_ONCE, STRETCHES_AT_ONCE = 500_000, 50_000


def word_hashes(text: str) -> Column:
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(words: str, at: str, mask: str, no: int) -> str:
    places = ", ".join(f"get({words}, {at} + {i})" for i, c in enumerate(mask) if c == "1")
    return f"xxhash64({no}, {places})"


def _seeds(words: str, at: str, masks: list[str], size: str) -> Column:
    """Array of the seeds that begin at a position; one that would reach over the end is null."""
    return F.array(*[F.expr(f"if({at} + {len(m)} <= {size}, {_seed(words, at, m, i)}, null)") for i, m in enumerate(masks)])


def _dense(marks: DataFrame, n: int, empty: str) -> DataFrame:
    """One row, one array ``bits``: for 0 .. n-1 the value of ``marks`` (at, bits), or ``empty``."""
    every = marks.sparkSession.range(n).select(F.col("id").cast("int").alias("at"))
    full = every.join(F.broadcast(marks), "at", "left").select(F.struct("at", F.expr(f"coalesce(bits, {empty})").alias("bits")).alias("b"))
    return full.agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["bits"]).alias("bits"))


def _bitmap(seeds: DataFrame, n: int) -> Column:
    """``n`` longs as a scalar subquery: a bit for each seed."""
    at, bit = F.expr(f"int(shiftrightunsigned(b_seed, 6) & {n - 1})"), F.expr("shiftleft(1L, int(b_seed & 63))")
    return _dense(seeds.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")), n, "0L").scalar()


def _vocabulary(items: DataFrame, n: int) -> Column:
    """``n`` booleans as a scalar subquery: whether a word of the benchmark has this remainder."""
    at = items.select(F.explode("b_words").alias("word")).select(F.expr(f"int(word & {n - 1})").alias("at")).distinct()
    return _dense(at.withColumn("bits", F.lit(True)), n, "false").scalar()


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """(doc_id, item_id, matched, compared, start): pairs that overlap, with their best window.

    ``matched`` of ``compared`` words agree; ``start`` is the first word of that window in the document.
    """
    shortest = min(map(len, masks))
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").alias("b_item"), word_hashes("text").alias("b_words"))
    items = items.withColumn("b_size", F.size("b_words")).where(F.col("b_size") >= MIN_WORDS)
    # Items are told apart by id and words: an item_id may stand for several texts.
    items = items.withColumn("b_key", F.xxhash64("b_item", "b_words")).dropDuplicates(["b_item", "b_key"])
    # At most a handful of values: lengths of the items that need masks of their own.
    under = max(shortest, *(n + 1 for n in SHORT_MASKS))
    short = sorted(r[0] for r in items.where(F.col("b_size") < under).select("b_size").distinct().collect())
    further: dict[str, list[int]] = {}  # mask: lengths of the items it serves; masks of the caller's may be longer than an item
    for n in short:
        for mask in SHORT_MASKS.get(n, ("1" * n,) if n < shortest else ()):
            if mask not in masks:
                further.setdefault(mask, []).append(n)
    every = [*masks, *further]
    longest = max(map(len, every))
    total, n_places = items.agg(F.sum(F.col("b_size") * F.when(F.col("b_size") < under, len(every)).otherwise(len(masks))), F.sum("b_size")).first()
    total, n_places = total or 0, n_places or 0

    own = docs.where("doc_id IS NOT NULL").select("doc_id", word_hashes("text").alias("words")).withColumn("size", F.size("words"))
    # Powers of two, in proportion to the seeds: 128 KB to 32 MB, and 64 KB to 16 MB.
    n_bits = 1 << min(22, max(14, (total // 2).bit_length()))
    n_words = 1 << min(24, max(16, (4 * total).bit_length()))
    at = items.select("b_item", "b_key", "b_words", "b_size", F.explode(F.expr("sequence(0, b_size - 1)")).alias("b_pos"))
    # The stretch of the item that a hit there is verified with.
    at = at.select("b_item", "b_key", "b_size", "b_pos", F.greatest(F.lit(0), F.col("b_pos") - window).alias("b_lo"), "b_words")
    stretch = at.select(F.col("b_key").alias("s_key"), F.col("b_pos").alias("s_pos"), F.expr(f"slice(b_words, b_lo + 1, {2 * window + longest})").alias("s_words"))
    at = at.select("b_item", "b_key", "b_size", "b_pos", "b_lo", F.posexplode(_seeds("b_words", "b_pos", every, "b_size")).alias("no", "b_seed"))
    # Further masks serve the items of their lengths only.
    serves = F.col("no") < len(masks)
    for no, sizes in enumerate(further.values(), len(masks)):
        serves |= (F.col("no") == no) & F.col("b_size").isin(sizes)
    at = at.where("b_seed IS NOT NULL").where(serves).drop("no")
    bits, vocabulary = _bitmap(at, n_bits), _vocabulary(items, n_words)
    # Positions become rows only inside one compiled step that tests them, and leave it where a seed may occur. (Tests in a
    # function over an array would not be compiled, nor would a test spelled out for each mask, which grows too long for the JVM:
    # so masks are rows too, with the distances of the places that they count; a place that a mask lacks is null, and hashes skip nulls.)
    # explode_outer: for an inner explode Spark would infer a filter that cuts every text into words twice.
    here = own.select("doc_id", "words", "size", F.explode_outer(F.expr("if(size > 0, sequence(0, size - 1), null)")).alias("pos"))
    counted = [[k for k, c in enumerate(mask) if c == "1"] for mask in every]
    most = max(map(len, counted))
    of = lambda no: [F.lit(k).cast("int") for k in [*counted[no], *[None] * (most - len(counted[no]))]]
    every_mask = F.array(*[F.struct(F.lit(no).alias("no"), F.lit(len(m)).alias("len"), *[c.alias(f"k{i}") for i, c in enumerate(of(no))]) for no, m in enumerate(every)])
    here = here.select("doc_id", "words", "size", "pos", F.explode(every_mask).alias("m"))
    # A seed is hashed only where all of its words are the benchmark's.
    may = F.col("pos") + F.col("m.len") <= F.col("size")
    for i in range(most):
        known = F.get(vocabulary, F.expr(f"int(get(words, pos + m.k{i}) & {n_words - 1})"))
        may &= known if all(len(c) > i for c in counted) else F.coalesce(known, F.col(f"m.k{i}").isNull())
    seed = F.expr(f"xxhash64(m.no, {', '.join(f'get(words, pos + m.k{i})' for i in range(most))})")
    word = F.get(bits, F.shiftrightunsigned(seed, 6).bitwiseAND(F.lit(n_bits - 1)).cast("int"))
    may &= F.call_function("shiftright", word, seed.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    near = here.where(may).withColumn("lo", F.expr(f"greatest(0, pos - {window})"))
    near = near.select("doc_id", "size", "pos", "lo", F.expr(f"slice(words, lo + 1, {2 * window + longest})").alias("words"), seed.alias("seed"))
    hit = near.join(F.broadcast(at) if total <= SEEDS_AT_ONCE else at, F.col("seed") == F.col("b_seed"))
    # Places of the item that lie inside the document and near the hit.
    hit = hit.withColumn("shift", F.expr("pos - b_pos")).withColumn("w", F.least(F.lit(window), "b_size"))
    hit = hit.withColumn("first", F.expr(f"greatest(0, b_pos - {window}, -shift)"))
    hit = hit.withColumn("last", F.expr(f"least(b_size, size - shift, b_pos + {window + longest}, lo - shift + size(words)) - 1"))
    hit = hit.where("last - first + 1 >= w").join(F.broadcast(stretch) if n_places <= STRETCHES_AT_ONCE else stretch, (F.col("b_key") == F.col("s_key")) & (F.col("b_pos") == F.col("s_pos")))
    # As rows of a generator these are worked out once a hit: Spark would write ``same`` into every window of ``best``, and both
    # into the join's condition. A hit whose whole stretch agrees too little has no window that does.
    once = lambda c, name: F.explode_outer(F.array(c)).alias(name)
    need = F.ceil(F.col("w") * F.lit(agree))
    same = F.expr("transform(sequence(first, last), t -> if(get(words, t + shift - lo) = get(s_words, t - b_lo), 1, 0))")
    hit = hit.select("doc_id", F.col("b_item").alias("item_id"), "w", "first", "shift", once(same, "same"))
    hit = hit.where(F.expr("aggregate(same, 0, (a, x) -> a + x)") >= need)
    best = F.expr(
        "array_max(transform(sequence(0, size(same) - w), s -> "
        "named_struct('n', aggregate(slice(same, s + 1, w), 0, (a, x) -> a + x), 'neg', -s - first - shift)))"
    )
    hit = hit.select("doc_id", "item_id", "w", once(best, "best")).where(F.col("best.n") >= need)
    hit = hit.groupBy("doc_id", "item_id").agg(F.max(F.struct("best.n", "w", "best.neg")).alias("m"))
    return hit.select("doc_id", "item_id", F.col("m.n").alias("matched"), F.col("m.w").alias("compared"), (-F.col("m.neg")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows whose doc_id overlaps a benchmark item."""
    leaked = contaminated(docs, benchmark, **parameters).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["leaked_id"], "left_anti")
