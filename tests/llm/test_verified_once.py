"""Decontamination: a hit is verified once, not once for each window and again in a join's condition."""

import re

from pyspark.sql import functions as F

from veridan.llm.decontaminate import contaminated


def _line(*words: str) -> str:
    return " ".join(words)


def test_joins_verify_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v")], "doc_id long, text string")
    bench = docs.select(F.col("doc_id").alias("item_id"), "text")
    found = contaminated(docs, bench)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"Join", x)]
    assert joins and not [x for x in joins if "lambda" in x]
    assert [tuple(r) for r in found.collect()] == [(1, 1, 20, 20, 0)]


def test_all_masks_and_windows(spark):
    """Items of 5 to 30 words, each whole and with a fifth of a window's words substituted, in texts of other words before and after."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(5, 31)}
    texts, want = [], set()
    for n, words in items.items():
        spoilt = list(words)
        for k in range(min(n, 20) // 5):
            spoilt[5 * k + 2] = "other"
        for no, part in enumerate((words, spoilt)):
            texts.append((2 * n + no, _line(*[f"x{k}" for k in range(no * 7)], *part, *[f"y{k}" for k in range(9)])))
            want.add((2 * n + no, n))
        texts.append((1000 + n, _line(*[w for w in words[: n - 1 if n < 20 else 15]][::2], *[f"z{k}" for k in range(30)])))  # too little of it
    docs = spark.createDataFrame([*texts, (5000, None), (5001, ""), (5002, "one")], "doc_id long, text string")
    bench = spark.createDataFrame([(n, _line(*w)) for n, w in items.items()], "item_id long, text string")
    got = contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {r["start"] for r in got if r["doc_id"] % 2 == 0} == {0} and {r["start"] for r in got if r["doc_id"] % 2 and r["item_id"] <= 20} == {7}
