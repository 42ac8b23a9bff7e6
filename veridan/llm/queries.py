"""The corpus operators' registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bpe, chat, decontaminate, langid, license_scan, merkle, ngram_join, quality, runs, token_files, url_filter, warc
from .common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100, count_links=True)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license that a text holds; of licenses that match one passage together, the best."""
    return license_scan.scan(_table(spark, sf_dir, "documents")).where("best").drop("best")


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(table, table.where("vec_id % 100 = 0"), k=10)


def op4_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.document_digests(spark, path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, held_out boolean, score double, predicted int")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (quality.fold() == 2).alias("held_out"), "score", "predicted")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("compared").cast("long").alias("compared"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.expr("array_join(transform(mask, m -> concat(m.start, '-', m.end)), ',')")
    return chat.rotate(_table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit_languages(docs))
    return found.select("doc_id", (quality.fold() == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.manifest(_table(spark, sf_dir, "documents"))).drop("nodes_copied")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text, some of which the contract makes periodic first."""
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


URL_RULES = [
    url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules; what no rule fits is allowed."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_ngram_jaccard, op2_license_scan, op3_ann_forest, op4_token_rans, op5_warc, op6_quality, op7_byte_bpe, op8_decontamination, op9_chat_rotation, op10_language_id, op11_merkle_manifest, op12_periodic_runs, op13_url_filter, pipeline)
    }


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node),
g AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id LEFT JOIN g ON g.a = d.doc_id
"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND n >= 100
"""

#: Every alignment of an item with a document that shares enough words, every window of it.
DECONTAMINATION_SQL = f"""
WITH dl AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS l FROM documents WHERE doc_id IS NOT NULL),
bl AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS l FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, len(l) AS size, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM dl),
b AS (SELECT item_id, len(l) AS n, least(len(l), {decontaminate.WINDOW}) AS k, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS t FROM bl WHERE len(l) >= {decontaminate.MIN_WORDS}),
m AS (SELECT doc_id, item_id, pos - t AS shift, t, n, k, size FROM d JOIN b USING (w)),
g AS (SELECT doc_id, item_id, shift, any_value(n) AS n, any_value(k) AS k, any_value(size) AS size, list(t) AS ts FROM m GROUP BY ALL HAVING count(*) >= ceil(any_value(k) * {decontaminate.AGREE})),
v AS (SELECT doc_id, item_id, k, ts, unnest(range(greatest(0, -shift), least(n, size - shift) - k + 1)) AS s FROM g),
x AS (SELECT doc_id, item_id, k, len(list_filter(ts, lambda t: t >= s AND t < s + k)) AS c FROM v)
SELECT doc_id, item_id, max(c) AS matched, any_value(k) AS compared FROM x WHERE c >= ceil(k * {decontaminate.AGREE}) GROUP BY doc_id, item_id
"""



def _merkle_sql(levels: int = 5) -> str:
    """Levels one by one, as deep as ``levels`` (16 ** levels leaves a source and sources); a group's highest node goes on by itself."""

    def tree(rows: str, tag: str) -> str:
        """Nodes {tag}0 .. {tag}levels over ``rows`` (g, i, n, h), and a leaf's neighbours at each level."""
        out = f"{tag}0 AS MATERIALIZED ({rows})"
        for k in range(levels):
            w = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            out += f""",
{tag}s{k} AS MATERIALIZED (SELECT g, i, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {tag}{k}),
{tag}{k + 1} AS MATERIALIZED (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {tag}{k} GROUP BY g, i // 16, n)"""
        return out

    enc = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head, low = "".join(f"{enc(c)} || " for c in merkle.FIELDS[:-1]), f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')"
    crc = "(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"
    path = " ".join(f"JOIN {t}s{k} AS {t}x{k} ON {t}x{k}.g = y.{t} AND {t}x{k}.i = y.{t}i // {16**k}" for t in "ab" for k in range(levels))
    fold, steps = "CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN changed ELSE h END AS v0", ""
    for j, (t, k) in enumerate((t, k) for t in "ab" for k in range(levels)):
        steps += f", f{j} AS (SELECT *, CASE WHEN {t}n{k} > 1 THEN sha256({t}l{k} || v{j} || {t}r{k}) ELSE v{j} END AS v{j + 1} FROM {f'f{j - 1}' if j else 'z'})"
    sides = ", ".join(f"{t}x{k}.n AS {t}n{k}, {t}x{k}.l AS {t}l{k}, {t}x{k}.r AS {t}r{k}" for t in "ab" for k in range(levels))
    proof = " || ".join(f"{t}l{k} || {t}r{k}" for t in "ab" for k in range(levels))
    return f"""
WITH d AS (SELECT doc_id, coalesce('x' || source, '') AS g, sha256({head}{enc('text')}) AS h, sha256({head}{enc(low)}) AS changed, {crc} AS crc FROM documents),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{tree("SELECT g, i, n, h FROM e", "a")},
t AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM a{levels}),
{tree("SELECT 'all' AS g, i, (SELECT count(*) FROM t) AS n, h FROM t", "b")},
y AS (SELECT e.*, e.g AS a, e.i AS ai, 'all' AS b, t.i AS bi, t.h AS subroot FROM e JOIN t ON t.g = e.g),
z AS (SELECT y.doc_id, y.h, y.subroot, {fold}, {sides} FROM y {path}){steps}
SELECT doc_id, f{2 * levels - 1}.h AS leaf, subroot, b{levels}.h AS root, sha256({proof}) AS proof_sha256, v{2 * levels} AS folded_root, v{2 * levels} = b{levels}.h AS verified FROM f{2 * levels - 1}, b{levels}
"""


URL_SQL = f"""
WITH c AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{merkle._UPPER}', '{merkle._LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM c),
r(verdict, host, path) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
f AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict FROM u LEFT JOIN r ON ends_with('.' || u.host, '.' || r.host) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": JACCARD_SQL, "op5_warc": WARC_SQL, "op8_decontamination": DECONTAMINATION_SQL, "op9_chat_rotation": chat.ROTATION_SQL,
        "op11_merkle_manifest": _merkle_sql(), "op13_url_filter": URL_SQL,
    }
