"""URL rules against a plain reading of each rule, wildcards against regular expressions."""

import random
import re

import numpy as np
import pytest

from veridan.llm import queries, url_filter
from veridan.llm.url_filter import BORDER, Rule, judge, matched, pack

URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://COM/x", "http://a.com?x=/en/", "http://a.com#/", "https://example.com/en/1", "https://example.com/en",
    "https://example.com/EN/1", "https://www.EXAMPLE.com/en/1?q#f", "https://m.www.example.com/en/", "https://notexample.com/en/", "https://xwww.example.com/en/x", "http://a.net/es/", "http://a.net/fr",
    "http://a.net/fr/../es/", "http://net/fr/x://y", "http://user@a.com:80/en/", "http://a.com.org/com/en/", "http://é.com/é", "http://x.org/a.com/en/", "ftp://a.net/es/\n//", "http://." + "a." * 50_000 + "com/" + "y" * 200_000,
]


def _plain(url, rules, default="allow"):
    """The contract read word by word."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({65 + i: 97 + i for i in range(26)})
    path = re.split(r"[?#]", rest[cut:], maxsplit=1)[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else default


def test_contract(spark):
    rows = [(i, u, "own", "own") for i, u in enumerate(URLS)] + [(None, URLS[10], "", ""), (3, URLS[10], "", "")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, rule string, host string"), queries.URL_RULES).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *_plain(u, queries.URL_RULES)) for i, u, *_ in rows), key=str)
    assert judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    nothing = judge(spark.createDataFrame(rows, "page_id long, url string, rule string, host string"), [], default="block").collect()
    assert {(r["rule"], r["verdict"]) for r in nothing} == {(None, "block")}


def _regex(host, path):
    def one(glob):
        return "".join({"**": "[^ÿ]*", "*": "[^/ÿ]*", "?": "[^/ÿ]"}.get(x) or re.escape(x) for x in re.findall(r"\*\*|[\s\S]", glob))

    return re.compile("[^/ÿ]*\\." + one(host) + "ÿ" + one(path) + "[^ÿ]*", re.DOTALL)


@pytest.mark.parametrize("seed", range(6))
def test_wildcards(seed):
    rng = random.Random(seed)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    globs = [(word("ab.*?é", 6), "/" + word("ab/*?é", 7)) for _ in range(120)]  # several words of 64 places
    exact = [_regex(*g) for g in globs]
    urls = [(word("ab.é", 9), "/" + word("ab/é", 12)) for _ in range(400)]
    got = matched([b"." + h.encode() + BORDER + p.encode() for h, p in urls], pack(globs))
    want = [next((i for i, e in enumerate(exact) if e.fullmatch(f".{h}ÿ{p}")), -1) for h, p in urls]
    assert got.tolist() == want and (np.array(want) >= 0).sum() > 20


def test_order_and_bound():
    assert matched([b".a.b\xff/x"], pack([("a.b", "/"), ("b", "/x")])).tolist() == [0]
    with pytest.raises(ValueError, match="places"):
        pack([("a" * 2_000_000, "/")])
    assert Rule("block", "net", "/es/").text == "net/es/" and url_filter.MOST_BYTES == 64 << 20
