"""Corpus operators against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridan.llm import ann_forest, bpe, chat, decontaminate, langid, license_scan, ngram_join, quality, token_files, warc
from veridan.llm.common import components, scratch

SCHEMA = "doc_id long, text string, digest string, key long, block int"  # the last three clash with inner names
WORDS = "the of and cat dog runs fast slow river stone maple winter summer quick brown fox jumps lazy over under table chair".split()


def _docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def _corpus(seed=3):
    rng = random.Random(seed)
    base = [_text(rng, n) for n in (3, 40, 60, 90, 200)]
    out = [None, "", "   ", "one", "one two", "One TWO", *base]
    for b in base[1:]:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(99))
            out.append(" ".join(w))
    shared = _text(rng, 30)
    out += [shared + " " + _text(rng, 60) for _ in range(5)] + [base[2], base[2].upper(), "long " * 5000, _text(rng, 5000)]
    return out


def _components(ids, texts, k, num, den):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [shingles(t) for t in texts]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = root(ids[i]), root(ids[j])
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize(("k", "num", "den", "block"), [(4, 85, 100, 8_000_000), (5, 4, 5, 300)])
def test_jaccard(spark, k, num, den, block):
    texts = _corpus()
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(_docs(spark, texts, ids), k, num, den, block).collect()}
    assert got == _components(ids, texts, k, num, den)
    assert len({c for _, c in got.values()}) < len(ids)


def test_jaccard_ids(spark):
    t = "a b c d e f g h"
    rows = ngram_join.jaccard_components(_docs(spark, [t, t, t, t], [5, 5, None, 9])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == [(-1, None), (5, 5), (5, 5), (9, 5)]
    assert ngram_join.jaccard_components(_docs(spark, [])).count() == 0


def test_signature_tree_links_connect_all_similar_sets():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        b = rng.integers(0, 1 << 60, rng.integers(20, 200), dtype=np.uint64)
        sets += [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 1 << 60, len(b), dtype=np.uint64), b)) for _ in range(10)]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def joined(links):
        up[:] = range(len(sets))
        for i, j in links:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
        return [root(i) for i in range(len(sets))]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    assert joined(ngram_join.tree_links(sets, 0, 4, 5, list(range(len(sets))))) == joined(every)
    cross = [(i, j) for i, j in every if (i < 100) != (j < 100)]
    assert joined(ngram_join.tree_links(sets, 100, 4, 5, list(range(len(sets))))) == joined(cross)


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def license_of(name, template, words):
    """The license that a matching passage counts as, read word by word: its own, or an unknown variant of its family."""
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    text = f" {' '.join(words)} "
    stands = lambda x: re.search(f" {re.escape(plain(x))} " + ("(?![1-9] )" if plain(x)[-1].isdigit() else ""), text)
    unknown = "unknown variant of "
    family = re.sub(r"-[\d.]+(-Clause)?$", "", name.removeprefix(unknown))
    sure = not name.startswith(unknown) and all(map(stands, re.findall(r"\{([^}]*)\}", template))) and not any(map(stands, license_scan.BARRED.get(name, [])))
    return name if sure else unknown + family


def test_licenses(spark):
    rng = random.Random(9)
    own = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    texts = [None, "", *[_text(rng, 70) + " " + re.sub("[{}]", "", t) + " " + _text(rng, rng.randrange(90)) for t in own], _text(rng, 500), re.sub("[{}]", "", own[0].upper() + "\n" + own[3])]
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(_docs(spark, texts)).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    templates = [(name, x, set(zip(words(x), words(x)[1:], strict=False))) for name, ts in license_scan.TEMPLATES.items() for x in ts]
    want = set()
    for i, t in enumerate(texts):
        w = words(t)
        pairs = list(zip(w, w[1:], strict=False))
        here = set(pairs)
        for name, x, s in templates:
            if len(s & here) >= 0.8 * len(s):
                for j in range(max(1, len(pairs))):
                    if len(s & set(pairs[j : j + len(s) + 2])) >= 0.8 * len(s):
                        want.add((i, license_of(name, x, w)))
                        break
    assert want <= got and len(want) >= 7
    assert {i for i, _ in got} == {i for i, _ in want}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 8)).astype(np.float32)
    v[300:400] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [None] * 8), (None, [1.0] * 8), (704, [1.0] * 3), (3, [float(x) for x in v[3]])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann_forest.nearest(t, t.where("vec_id % 100 = 7"), k=10, trees=6, visit=3.0, leaf_rows=20).collect()
    hit = 0
    for q in range(7, 600, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(600) if i != q)[:10]
        got = sorted((r["rank"], r["score"], r["vec_id"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(g[1] == d[g[2]] for g in got)
        hit += len({g[2] for g in got} & {w[1] for w in want})
    assert hit >= 54
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert ann_forest.nearest(few, few.where("vec_id = 0")).count() == 3
    assert ann_forest.nearest(few.limit(0), few).count() == 0


def test_rans():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 600_001), 40000).astype(np.int64)
    c = token_files.Coder(token_files.scaled(np.bincount(ids, minlength=65536)))
    e = c.encode(ids)
    assert (c.decode(len(ids), e["words"], e["states"], e["places"]) == ids).all()
    step = token_files.LANES * token_files.CHECKPOINT
    assert (c.decode(len(ids), e["words"], e["states"], e["places"], start=1, stop=2) == ids[step : 2 * step]).all()
    assert len(e["words"]) * 8 / len(ids) < 7
    for n in (0, 1, 1023, 1024, 1025):
        e = c.encode(ids[:n])
        assert (c.decode(n, e["words"], e["states"], e["places"]) == ids[:n]).all()


def test_token_files(spark):
    texts = [None, "", " Hello, WORLD... it's é 12ab_.x <|endoftext|>x", "naïvé İstanbul ΟΔΟΣ áb", "tab\tand space", "," * 50, *_corpus()]
    ids = [7, 3, 3, None, *range(10, 6 + len(texts))]
    path = scratch(spark, "test")
    file = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(_docs(spark, texts, ids), path, file)
    got = token_files.document_digests(spark, path).collect()
    t = Tokenizer.from_file(file)
    want = sorted((i if i is not None else -1, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, x in zip(ids, texts, strict=True))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_crc32"]) for r in got) == want
    got = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(i for i in ids if i is not None)
    token_files.write_token_files(_docs(spark, []), path + "-none", file)
    assert token_files.document_digests(spark, path + "-none").count() == 0


@pytest.mark.parametrize("split", ["300", "134217728"])
def test_warc(spark, split):
    fake = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rng = random.Random(5)
    htmls = [None, "", "short", "short", "end\r\n", "\r\n\r\nstart", "a\r\n" * 60, fake, fake * 9, "é" * 500, _text(rng, 900), "z" * 120, "z" * 120, "z" * 120, "\r\nWARC/1.1\r\nContent-Length: 3\r\n"]
    rows = [(50 - i, f"http://h/{i}\r\nX: y" if i % 3 else None, h, "clash") for i, h in enumerate(htmls)] + [(None, "u", "z" * 120, "c")]
    path = scratch(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r["page_id"]: tuple(r)[1:] for r in warc.page_records(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h, _ in rows:
        b, f = (h or "").encode(), first[h or ""]
        again = len(b) >= 100 and f != i
        assert got[i] == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None), i
    assert len(got) == len(rows)
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path + "-none")
    assert warc.page_records(spark, path + "-none").count() == 0


def _labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality(spark, sf):
    docs, labels = _labelled(spark, sf.replace("sf0.001", "sf0.01"))
    m = quality.fit_quality(docs, labels)
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, " \n", 9.0), (3, "word " * 100000, 9.0)], "doc_id long, text string, score double")
    s = [r["score"] for r in quality.score_quality(odd, m).collect()]
    assert all(0 <= x <= 1 for x in s) and s[0] == s[1] == s[2]
    assert quality.score_quality(odd.limit(0), m).count() == 0
    held = quality.score_quality(docs, m).join(labels, "doc_id").where(quality.fold() == 2).toPandas()
    good, bad = held.loc[held.quality == 1, "score"], held.loc[held.quality == 0, "score"]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85 and (good >= 0.7).mean() > 0.9
    with pytest.raises(ValueError, match="at least 8"):
        quality.fit_quality(docs, labels.where("quality = 1"))


def test_language(spark, sf):
    docs, _ = _labelled(spark, sf.replace("sf0.001", "sf0.01"))
    m = langid.fit_languages(docs)
    held = langid.identify(docs, m).where(quality.fold() == 2).toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 3!", "a"), (4, "the " * 50000, "a")], "doc_id long, text string, lang_pred string")
    assert [r["lang_pred"] for r in langid.identify(odd, m).collect()] == ["und", "und", "und", "en"]
    assert langid.identify(odd.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        langid.fit_languages(docs.limit(0))
    c = langid.codewords(4)
    assert min((c[i] != c[j]).sum() for i in range(4) for j in range(i)) >= 6


def test_bpe(spark):
    texts = [None, "", " ", "  lead", "trail ", "a\nb", "a \n b", "x\n\ny", "it's I'LL  we've", " nb sp\x1cfs\x85", "tab\there", "日本語 テキスト 12３", "👍🏽 ok", "é ́", "\x00nul", *_corpus()]
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.token_digests(_docs(spark, texts)).collect()}
    whole = {r["doc_id"]: (r["ids"], bytes(r["decoded"]), r["key"]) for r in bpe.decode(bpe.encode(_docs(spark, texts))).collect()}
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), repr(t)
        assert whole[i] == (ids, (t or "").encode(), 1)
    assert bpe.encode(_docs(spark, [])).count() == 0


def test_masks_hit_any_window_with_four_substitutions():
    rng = random.Random(0)
    for _ in range(3000):
        bad = set(rng.sample(range(20), 4))
        assert any(all(o + i not in bad for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for o in range(21 - len(m)))


def test_decontamination(spark):
    rng = random.Random(8)
    items = [_text(rng, n) for n in (4, 5, 6, 12, 20, 45, 70)] + [None, ""]
    texts, want = [None, "", "the of", _text(rng, 4000)], set()
    for i, x in enumerate(items[:7]):
        w = x.split()
        if len(w) < 5:
            texts.append(x)
            continue
        for subs in (0, 2 if len(w) >= 12 else 0):
            v = list(w)
            for j in rng.sample(range(len(w)), subs):
                v[j] = "other" + str(j)
            want.add((len(texts), i))
            texts.append(_text(rng, 25) + " " + ", ".join(v).upper() + ". " + _text(rng, 25))
    want.add((len(texts), 6))
    texts.append(" ".join(items[6].split()[20:50]))  # a part of an item, at both ends of the text
    bench = spark.createDataFrame([(i, x, 1) for i, x in enumerate(items)] + [(None, items[5], 1)], "item_id long, text string, size int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(_docs(spark, texts), bench).collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.decontaminate(_docs(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(_docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(_docs(spark, []), bench).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind", "c"), (1, 1, "ann", "hi", "c"), (1, 2, "bob", None, "c"), (1, 300, "ann", "bye", "c"), (1, 1, "ann", "hi", "c"), (2, None, None, "x", "c"), (None, 0, "ann", "y", "c"), (3, 0, "system", "z", "c")]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, mask string")
    got = {(r["conv_id"], r["perspective"], r["part_turn"]): (r["text"], [r["text"][m["start"] : m["end"]] for m in r["mask"]]) for r in chat.rotate(t).collect()}
    assert got[1, "ann", 0] == ("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n", ["hi<|end|>"])
    assert got[1, "bob", 0][1] == ["<|end|>"] and got[1, "ann", 256][1] == ["bye<|end|>"]
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 256), (1, "bob", 256), (2, "unknown", -256)}
    many = spark.createDataFrame([(1, 0, "ann", f"t{i}") for i in range(30)], "conv_id long, turn int, role string, text string")
    parts = chat.rotate(many, most=10).collect()
    assert len(parts) == 3 and sum(r["n_turns"] for r in parts) == 30
    assert chat.rotate(many.where(F.lit(False))).count() == 0


def test_jaccard_one_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = ngram_join.jaccard_components(_docs(spark, [a, b, a, b, c, a], [7, 7, 4, 9, 5, 7])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(4, 4), (5, 5), (7, 4), (7, 4), (7, 4), (9, 4)]


def test_jaccard_with_hot_keys(spark, monkeypatch):
    """Keys that a sample shows to be hot skip the count; the links are the same."""
    monkeypatch.setattr(ngram_join, "SAMPLED", 1)
    monkeypatch.setattr(ngram_join, "HOT", 3)
    texts = _corpus(4)
    ids = list(range(len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(_docs(spark, texts, ids), 4, 85, 100).collect()}
    assert got == _components(ids, texts, 4, 85, 100)
