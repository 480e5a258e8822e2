"""The operators' queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import decontaminate, html, jaccard, pii, quality, sharding, tokens, topk, urlfilter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # The number in a page's path is the doc_id of its document, which the labels are of.
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1) AS bigint)")
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urlfilter.judge(pages, labelled, URL_RULES)


def url_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 has of host and path rules alone; SQL can express that."""
    u = F.col("url")
    h, p = urlfilter.host(u), urlfilter.path(u)
    name, verdict = urlfilter.rule(h, p, URL_RULES)
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), p.alias("path"), name.alias("rule"), verdict.alias("rule_verdict"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def pii_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 has of the patterns alone; SQL can express that."""
    t = F.col("text")
    spans = pii.base_spans(t)
    counts = [F.size(F.filter(spans, pii._of_kind(k))).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return table(spark, sf_dir, "documents").select("doc_id", *counts, F.sha2(pii.joined(spans).cast("binary"), 256).alias("base_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_html, op3_quality, op4_sharding, op5_jaccard_join, op6_token_counts, op7_topk, op8_url_filter, url_host_rules, op9_pii, pii_patterns, op10_byte_bpe)
}

def _sql_pii() -> str:
    """Places of matches from the gaps between them: matches and gaps in turn add up to the text."""
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len([x FOR x IN string_split(v, '.') IF coalesce(try_cast(x AS UBIGINT), 256) > 255]) = 0")]
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    each = f"[CASE WHEN (length({digits}) - i) % 2 = 0 THEN {digits}[i]::INTEGER WHEN {digits}[i]::INTEGER > 4 THEN {digits}[i]::INTEGER * 2 - 9 ELSE {digits}[i]::INTEGER * 2 END FOR i IN range(1, length({digits}) + 1)]"
    kinds += [("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND list_sum({each}) % 10 = 0"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15")]
    parts = []
    for k, (name, p, ok) in enumerate(kinds):
        parts.append(f"""SELECT doc_id, {k} AS k, '{name}' AS kind, v, before + sum(gap + length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) AS a, {ok} AS ok FROM (
          SELECT doc_id, i, m[i] AS v, length(g[i]) AS gap, 0 AS before FROM (
            SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d)))""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}),
p AS (SELECT doc_id, {', '.join(f"count(*) FILTER (k = {k}) AS n_{n}" for k, (n, _, _) in enumerate(kinds))}, string_agg(kind || ':' || a::BIGINT || ':' || (a + length(v))::BIGINT, ',' ORDER BY a, k) AS s FROM s WHERE ok GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n, _, _ in kinds)}, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN p USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "pii_patterns": _sql_pii(),
    "op1_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0 AND item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT doc_id, i, places.n, item_id FROM places JOIN wins USING (t) WHERE places.n = wins.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_topk": """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_transform(range(1, len(q.e) + 1), lambda i: [q.e[i], c.e[i]])])::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "url_host_rules": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path, m.h || m.p AS rule, m.v AS rule_verdict
FROM (SELECT u.*, (SELECT max_by({'v': v, 'h': h, 'p': p}, length(h || p)) FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS m FROM u)""",
    # No CRC function in SQL: the checksum is worked out bit by bit.
    "op4_sharding": """
WITH t AS (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS c FROM range(0, 256) r(i)),
crc AS (SELECT list(c ORDER BY i) AS c FROM t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS s, hex(encode(coalesce(text, ''))) AS b FROM documents),
sums AS (SELECT doc_id, s, length(b) // 2 + 1 AS size,
   xor(4294967295, list_reduce([('0x' || substr(b, 2 * k - 1, 2))::BIGINT FOR k IN range(1, length(b) // 2 + 1)], lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) AS crc FROM d, crc),
scored AS (SELECT *, [{'v': -ln((('0x' || substr(md5(s || ':' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496), 'k': k} FOR k IN range(0, 9)] AS r FROM sums)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, list_min(r[1:8]).k::INTEGER AS shard,
       (row_number() OVER (PARTITION BY list_min(r[1:8]).k ORDER BY md5(s || '/' || crc || '/' || size), doc_id) - 1)::BIGINT AS slot,
       list_min(r).k::INTEGER AS grown_shard
FROM scored""",
}
