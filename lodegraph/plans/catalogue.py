"""Every query over the test tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate, graph, route, search, snapshot, spans
from ..streaming import coalesce as streams
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- lexical search ------------------------------------------------------------------------------------------------


def _sql_fold(c: str) -> str:
    return f"translate(lower({c}), '{tx.FOLD_FROM}', '{tx.FOLD_TO}')"


def _sql_bm25(source: str, id_col: str, weights: dict[str, float], text_query: str, limit: int | None) -> str:
    """BM25 by exploded postings: another way to the same figures as the engine's counting in place."""
    phrases = tx.query_phrases(text_query)
    cols = " UNION ALL ".join(f"SELECT {id_col} AS id, {w}::DOUBLE AS w, regexp_extract_all({_sql_fold(c)}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t FROM {source}" for c, w in weights.items())
    parts = []
    for k, p in enumerate(phrases):
        same = " AND ".join(f"t[i + {j}] = '{word}'" for j, word in enumerate(p))
        parts.append(f"SELECT {k} AS p, id, w FROM (SELECT id, w, t, unnest(range(1, len(t) + 1)) AS i FROM c) WHERE {same}")
    top = f" ORDER BY score, {id_col} LIMIT {limit}" if limit else ""
    return f"""WITH c AS MATERIALIZED ({cols}),
lens AS (SELECT id, sum(len(t)) AS len FROM c GROUP BY id), st AS (SELECT count(*) AS n, avg(len) AS a FROM lens),
f AS (SELECT p, id, sum(w) AS f FROM ({" UNION ALL ".join(parts)}) GROUP BY p, id),
d AS (SELECT p, count(*) AS np FROM f GROUP BY p),
idf AS (SELECT p, CASE WHEN ln((n - np + 0.5) / (np + 0.5)) > 0 THEN ln((n - np + 0.5) / (np + 0.5)) ELSE 1e-6 END AS idf FROM d, st),
s AS (SELECT id AS {id_col}, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM f JOIN idf USING (p) JOIN lens USING (id), st GROUP BY id)
SELECT {id_col}, score FROM s{top}"""


@query(_sql_bm25("documents", "doc_id", {"text": 1.0}, "ering pour+la Ciónes", None))
def bm25_documents(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", {"text": 1.0}, "ering pour+la Ciónes", None).withColumn("score", r6("score"))


@query(_sql_bm25("documents", "doc_id", {"text": 1.0}, "apache_license the.of", None))
def bm25_phrase(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", {"text": 1.0}, "apache_license the.of", None).withColumn("score", r6("score"))


_PART_WEIGHTS = {"p_name": 10.0, "p_brand": 8.0, "p_type": 2.0}


@query(_sql_bm25("part", "p_partkey", _PART_WEIGHTS, "red brand#11 steel", None))
def bm25_weighted_part(spark, d):
    return search.bm25(table(spark, d, "part"), "p_partkey", _PART_WEIGHTS, "red brand#11 steel", None).withColumn("score", r6("score"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'Brand#11' OR p_brand = 'Brand#11' OR p_type = 'Brand#11'")
def exact_lookup(spark, d):
    p = table(spark, d, "part")
    return p.filter((F.col("p_name") == "Brand#11") | (F.col("p_brand") == "Brand#11") | (F.col("p_type") == "Brand#11")).select("p_partkey", "p_name", "p_brand")


# -- dense search and fusion ---------------------------------------------------------------------------------------


def _vector(spark, d, i: int) -> list[float]:
    row = table(spark, d, "embeddings").filter(F.col("vec_id") == i).select("embedding").first()
    return list(row[0])


def _sql_knn(limit: int, where: str = "") -> str:
    return f"""SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance,
row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id)::INTEGER AS dense_rank FROM embeddings {where} ORDER BY dense_rank LIMIT {limit}"""


@query(_sql_knn(30))
def knn_l2(spark, d):
    return search.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(spark, d, 0), 30).withColumn("distance", r6("distance"))


@query(_sql_knn(30, "WHERE label = 1"))
def knn_l2_filtered(spark, d):
    return search.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(spark, d, 0), 30, F.col("label") == 1).withColumn("distance", r6("distance"))


def _hybrid(spark, d, bonus: Column | None = None) -> DataFrame:
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    lexical = search.bm25(docs, "doc_id", {"text": 1.0}, "ering pour+la Ciónes", 30)
    # Both ids count from 0; vectors without a document drop out.
    known = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    dense = search.knn(known, "vec_id", "embedding", _vector(spark, d, 0), 30).withColumnRenamed("vec_id", "doc_id")
    return search.rrf(lexical, dense, "doc_id", bonus=bonus)


_SQL_HYBRID = f"""WITH lex0 AS ({_sql_bm25("documents", "doc_id", {"text": 1.0}, "ering pour+la Ciónes", None).replace("round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))), 6)", "-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a)))")}),
lex AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id)::INTEGER AS lexical_rank FROM lex0 QUALIFY lexical_rank <= 30),
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], e), vec_id)::INTEGER AS dense_rank FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY dense_rank <= 30),
both_ AS (SELECT coalesce(lex.doc_id, den.doc_id) AS doc_id, lexical_rank, dense_rank, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) %s AS score FROM lex FULL JOIN den ON lex.doc_id = den.doc_id)"""


@query(_SQL_HYBRID % "" + " SELECT doc_id, lexical_rank, dense_rank, round(score, 6) AS score FROM both_")
def rrf_hybrid(spark, d):
    return _hybrid(spark, d).withColumn("score", r6("score"))


@query(_SQL_HYBRID % "+ CASE WHEN coalesce(lex.doc_id, den.doc_id) % 5 = 0 THEN 1.0::DOUBLE / 61 ELSE 0 END" + " SELECT doc_id, lexical_rank, dense_rank, round(score, 6) AS score FROM both_")
def rrf_exact_bonus(spark, d):
    return _hybrid(spark, d, F.col("doc_id") % 5 == 0).withColumn("score", r6("score"))


@query(
    _SQL_HYBRID % ""
    + """, g AS (SELECT both_.*, source, text, row_number() OVER (PARTITION BY source ORDER BY score DESC, lexical_rank NULLS LAST, dense_rank NULLS LAST) AS n FROM both_ JOIN documents USING (doc_id))
SELECT doc_id, source, round(score, 6) AS score, length(text)::BIGINT AS n_chars, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM g WHERE n <= 3 ORDER BY g.score DESC, lexical_rank NULLS LAST, dense_rank NULLS LAST LIMIT 10"""
)
def hybrid_search_documents(spark, d):
    """Search as a user has it: both lists fused, three results a source, ten in all; texts joined last."""
    docs = table(spark, d, "documents")
    fused = _hybrid(spark, d)
    named = fused.join(docs.select("doc_id", "source"), "doc_id")
    best = search.cap_per_group(named, search.rrf_order(), ["source"], 3, 10)
    out = docs.join(F.broadcast(best.select("doc_id", "score")), "doc_id")  # ten rows
    return out.select("doc_id", "source", r6("score").alias("score"), F.length("text").cast("long").alias("n_chars"), tx.token_estimate(F.col("text")).alias("n_tokens"))


@query("""SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) AS m FROM part) WHERE m = 1) WHERE n <= 3 ORDER BY p_retailprice DESC, p_partkey LIMIT 50""")
def cap_per_group(spark, d):
    order = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    return search.cap_per_group(table(spark, d, "part"), order, ["p_brand"], 3, 50, ["p_brand", "p_name"]).select("p_partkey", "p_brand", "p_retailprice")


# -- routing -------------------------------------------------------------------------------------------------------

_SQL_SYMBOL = "|".join((route.SNAKE, route.CAMEL, route.UPPER))


def _sql_classify(q: str) -> str:
    e = lambda s: s.replace("'", "''")
    return f"""CASE WHEN length(trim({q})) < 2 THEN 'local'
WHEN regexp_full_match(trim({q}), '{e(route.DOTTED)}|{e(route.SNAKE)}|{e(route.CAMEL)}') OR regexp_full_match(regexp_extract(trim({q}), '^\\S+'), '{route.UPPER}') THEN 'symbol'
WHEN regexp_matches(trim({q}), '{e(route.FILE)}') THEN 'symbol'
WHEN regexp_matches(lower({q}), '{e(route.IMPACT)}') THEN 'impact' WHEN regexp_matches(lower({q}), '{e(route.DEBUG)}') THEN 'debugging'
WHEN NOT regexp_matches(lower({q}), '{e(route.CONCEPT)}') AND len(regexp_extract_all(trim({q}), '\\S+')) <= 3
 AND len(list_filter(regexp_extract_all({q}, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: regexp_full_match(t, '{_SQL_SYMBOL}'))) > 0 THEN 'symbol' ELSE 'local' END"""


_ASKED = ["parse_token", "TokenValidator", "Parser", "a", "what calls TokenValidator", "who uses validate", "what breaks if I change parse_token", "why does login fail", "how does the parser work", "README.md overview", "HTTP client", "os.path.exists", "find FooBar quickly", "token cache", "error in terror", "where is parse defined"]
_SQL_ASKED = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(_ASKED)) + ") v(id, q)"


@query(f"SELECT id::BIGINT AS id, {_sql_classify('q')} AS class FROM (SELECT id, q FROM {_SQL_ASKED} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')")
def classify_queries(spark, d):
    own = spark.createDataFrame(list(enumerate(_ASKED)), "id long, q string")
    asked = table(spark, d, "conversations").filter("role = 'user'").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    return own.union(asked).select("id", route.classify(F.col("q")).alias("class"))


@query(f"SELECT class, count(*) AS n, any_value(CASE class WHEN 'symbol' THEN 800 WHEN 'debugging' THEN 4000 WHEN 'impact' THEN 6000 ELSE 2000 END)::INTEGER AS tokens, any_value(CASE class WHEN 'symbol' THEN 3 WHEN 'debugging' THEN 8 WHEN 'impact' THEN 10 ELSE 5 END)::INTEGER AS top_k FROM (SELECT {_sql_classify('text')} AS class FROM conversations) GROUP BY class")
def budgets_by_class(spark, d):
    kind = F.col("class")
    out = table(spark, d, "conversations").select(route.classify(F.col("text")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return out.select("class", "n", route.budget(kind).alias("tokens"), route.top_k(kind).alias("top_k"))


@query("SELECT * FROM (VALUES ('what calls TokenValidator', 'TokenValidator'), ('who uses validate', 'validate'), ('what breaks if I change parse_token', 'parse_token')) v(q, symbol)")
def impact_symbol(spark, d):
    asked = ["what calls TokenValidator", "who uses validate", "what breaks if I change parse_token"]
    return spark.createDataFrame([(q, route.impact_symbol(q)) for q in asked], "q string, symbol string")


# -- spans, chunks, budgets ----------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM l WHERE used <= 800 GROUP BY doc_id)
SELECT doc_id, coalesce(kept, '') AS evidence, greatest(1, length(coalesce(kept, '')) // 4)::BIGINT AS n_tokens FROM documents LEFT JOIN k USING (doc_id)""")
def token_budget_trim(spark, d):
    out = table(spark, d, "documents").select("doc_id", spans.trim_to_budget(F.col("text"), 200).alias("evidence"))
    return out.withColumn("n_tokens", tx.token_estimate(F.col("evidence")))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS text, len(string_split(text, chr(10)))::INTEGER AS total_lines FROM documents")
def read_lines(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", spans.read_lines(t, 2, 3).alias("text"), F.size(spans.lines(t)).alias("total_lines"))


_SQL_CHUNKS = "SELECT doc_id, c::INTEGER AS chunk, (c * 600)::INTEGER AS start, substr(text, c * 600 + 1, 600) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 599) // 600)) AS c FROM documents)"


@query(_SQL_CHUNKS)
def chunk_600(spark, d):
    return spans.chunks(table(spark, d, "documents"), "doc_id", "text")


def _line_units(docs: DataFrame) -> DataFrame:
    """Each document as nested units: itself (0) and its lines (from 1), by characters."""
    each = docs.select("doc_id", F.posexplode(spans.lines(F.col("text"))).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("line") + 1).over(w) - 1
    lines = each.select("doc_id", (F.col("i") + 1).alias("unit"), (end - F.length("line")).cast("int").alias("s"), end.cast("int").alias("e"))
    return lines.union(docs.select("doc_id", F.lit(0), F.lit(0), F.length("text")))


_SQL_UNITS = """units AS (SELECT doc_id, i::INTEGER AS unit, (e - length(line))::INTEGER AS s, e::INTEGER AS e FROM (SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
UNION ALL SELECT doc_id, 0, 0, length(text)::INTEGER FROM documents)"""


@query(f"WITH {_SQL_UNITS}, c AS ({_SQL_CHUNKS}) SELECT doc_id, chunk, start, unit FROM (SELECT c.doc_id, chunk, start, unit, row_number() OVER (PARTITION BY c.doc_id, chunk ORDER BY e - s, unit) AS n FROM c JOIN units u ON u.doc_id = c.doc_id AND s <= start AND e >= start) WHERE n = 1")
def chunk_unit_at(spark, d):
    docs = table(spark, d, "documents")
    return spans.smallest_container(spans.chunks(docs, "doc_id", "text").drop("text"), _line_units(docs), "doc_id", "start", ["chunk"], "unit", "s", "e")


@query(f"WITH {_SQL_UNITS} SELECT * EXCLUDE (n) FROM (SELECT a.doc_id, a.unit, b.unit AS parent_id, row_number() OVER (PARTITION BY a.doc_id, a.unit ORDER BY b.e - b.s, b.unit) AS n FROM units a LEFT JOIN units b ON a.doc_id = b.doc_id AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s) WHERE n = 1")
def containment_parent(spark, d):
    units = _line_units(table(spark, d, "documents")).withColumn("u", F.struct("doc_id", "unit"))
    out = spans.containment_parent(units, "doc_id", "u", "s", "e")
    return out.select("doc_id", "unit", F.col("parent_id.unit").alias("parent_id"))


@query("""WITH s AS (SELECT user_id, ts AS s, ts + INTERVAL 12 HOUR AS e, event_id AS view_id FROM events WHERE event_type = 'view')
SELECT event_id, view_id FROM (SELECT ev.event_id, ev.ts, m.view_id, m.e FROM (SELECT * FROM events WHERE event_type = 'purchase') ev
ASOF JOIN (SELECT user_id, s, max(view_id) AS view_id, max_by(e, view_id) AS e FROM s GROUP BY user_id, s) m ON ev.user_id = m.user_id AND ev.ts >= m.s) WHERE ts < e""")
def asof_span_map(spark, d):
    events = table(spark, d, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("e"), F.col("event_id").alias("view_id"))
    points = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return spans.asof_map(points, views, "user_id", "ts", "s", "e", "view_id").select("event_id", "view_id")


@query("""SELECT page_id, i::INTEGER AS block, tag, sum(CASE WHEN tag IN ('h1', 'p><b') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i)::BIGINT AS section
FROM (SELECT page_id, unnest(t) AS tag, unnest(range(0, len(t))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p><b|p|footer|nav)>', 1) AS t FROM pages))""")
def sections_from_headings(spark, d):
    each = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h1|p><b|p|footer|nav)>"), F.lit(1))).alias("block", "tag"))
    return spans.sections(each, "page_id", "tag", "block", F.col("tag").isin("h1", "p><b"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_config_keys(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("SELECT page_id, url, string_split(url, '.')[-1] AS last FROM pages")
def split_callee_url(spark, d):
    return table(spark, d, "pages").select("page_id", "url", tx.last_segment(F.col("url")).alias("last"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


# -- call graph ----------------------------------------------------------------------------------------------------


def _values(name: str) -> str:
    return fixtures.sql(name)


_SQL_CTES = ", ".join(f"{n} AS ({_values(n)})" for n in ("units", "edges", "aliases", "files"))
_SQL_CALLERS = """(SELECT e.*, u.name AS cn, u.qualname AS cq FROM edges e LEFT JOIN units u ON u.unit_id = e.callee_unit_id)"""


def _sql_direct(target: str) -> str:
    return f"""SELECT caller_unit_id AS unit_id, line, callee_full AS call, NULL::VARCHAR AS resolved_target, 0 AS b FROM {_SQL_CALLERS}
WHERE callee = '{target}' OR callee_full = '{target}' OR cn = '{target}' OR cq = '{target}' OR lower(callee_full) LIKE '%.{target.lower().replace("_", "#_")}' ESCAPE '#' OR lower(callee_full) LIKE '%::{target.lower().replace("_", "#_")}' ESCAPE '#'"""


def _sql_pick(body: str) -> str:
    return f"SELECT unit_id, line, call, resolved_target FROM (SELECT d.*, row_number() OVER (PARTITION BY d.unit_id ORDER BY b, (contains(lower(file_path), 'test'))::INTEGER, line, call) AS n FROM ({body}) d JOIN units USING (unit_id)) WHERE n = 1"


@query(f"WITH {_SQL_CTES} {_sql_pick(_sql_direct('stage2'))}")
def callers_direct(spark, d):
    u, e, a, _ = fixtures.frames(spark)
    return graph.callers(spark.createDataFrame([("stage2",)], "target string"), e, u, a).drop("target")


_SQL_ALIAS = """SELECT caller_unit_id AS unit_id, line, callee_full AS call, target AS resolved_target, 1 AS b FROM edges e JOIN aliases a ON a.file_id = e.file_id AND (callee_full = alias OR callee_full LIKE alias || '.%')
WHERE target || substr(callee_full, length(alias) + 1) = '{t}' AND NOT EXISTS (SELECT 1 FROM units s WHERE s.file_id = e.file_id AND s.name = alias AND s.kind = 'symbol' AND s.unit_type NOT IN ('import', 'config_key'))"""


@query(f"WITH {_SQL_CTES} " + " UNION ALL ".join(f"SELECT '{t}' AS target, * FROM ({_sql_pick(_sql_direct(t) + ' UNION ALL ' + _SQL_ALIAS.format(t=t))})" for t in ("os.path.exists", "core.http.fetch", "core.auth.validate", "other.mod.fetch")))
def callers_alias(spark, d):
    u, e, a, _ = fixtures.frames(spark)
    names = spark.createDataFrame([("os.path.exists",), ("core.http.fetch",), ("core.auth.validate",), ("other.mod.fetch",)], "target string")
    return graph.callers(names, e, u, a)


@query(f"""WITH RECURSIVE {_SQL_CTES}, link AS (SELECT DISTINCT e.caller_unit_id AS a, u.unit_id AS b FROM {_SQL_CALLERS} e JOIN units u ON e.callee IN (u.name, u.qualname) OR e.callee_full IN (u.name, u.qualname) OR e.cn IN (u.name, u.qualname) OR e.cq IN (u.name, u.qualname) OR ends_with(lower(callee_full), '.' || lower(u.name)) OR ends_with(lower(callee_full), '.' || lower(u.qualname))),
r AS (SELECT a AS unit_id, 1 AS hop FROM link WHERE b IN (SELECT unit_id FROM units WHERE name = 'stop') UNION SELECT link.a, hop + 1 FROM r JOIN link ON link.b = r.unit_id WHERE hop < 3)
SELECT unit_id, min(hop)::INTEGER AS hop FROM r GROUP BY unit_id""")
def transitive_callers(spark, d):
    u, e, _, _ = fixtures.frames(spark)
    return graph.transitive("stop", e, u, 3)


@query(f"""WITH {_SQL_CTES}, s AS (SELECT * FROM units WHERE kind = 'symbol' AND unit_type NOT IN ('import', 'config_key')), e AS (SELECT edges.*, target, CASE WHEN contains(callee_full, '.') THEN substr(callee_full, instr(callee_full, '.')) ELSE '' END AS rest FROM edges LEFT JOIN aliases a ON a.file_id = edges.file_id AND a.alias = string_split(callee_full, '.')[1])
SELECT edge_id, file_id, callee, callee_full, coalesce(
 (SELECT CASE WHEN count(*) = 1 THEN min(unit_id) END FROM s WHERE s.file_id = e.file_id AND (name = callee OR qualname = callee)),
 (SELECT CASE WHEN count(*) = 1 THEN min(unit_id) END FROM s WHERE qualname = target || rest),
 (SELECT CASE WHEN count(*) = 1 THEN min(unit_id) END FROM s WHERE replace(regexp_replace(file_path, '\\.[^./]*$', ''), '/', '.') || '.' || qualname = target || rest),
 (SELECT CASE WHEN count(*) = 1 THEN min(unit_id) END FROM s WHERE name = callee)) AS callee_unit_id FROM e""")
def resolve_edges(spark, d):
    u, e, a, _ = fixtures.frames(spark)
    return graph.resolve_edges(e, u, a)


@query(f"WITH {_SQL_CTES} SELECT file_path, via FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY b, via) AS n FROM (SELECT f.path AS file_path, target AS via, 0 AS b FROM aliases JOIN files f USING (file_id) WHERE target = 'core' OR starts_with(target, 'core.') UNION ALL SELECT file_path, qualname, 1 FROM units WHERE unit_type = 'import' AND (qualname = 'core' OR starts_with(qualname, 'core.')))) WHERE n = 1")
def dependents(spark, d):
    u, _, a, f = fixtures.frames(spark)
    return graph.importers(u, a, f, "core")


@query(f"WITH {_SQL_CTES} SELECT unit_id, name, qualname FROM units WHERE kind = 'symbol' AND unit_type <> 'import' AND (name = 'validate' OR qualname = 'validate' OR ends_with(qualname, '.validate'))")
def resolve_symbol(spark, d):
    return graph.resolve(fixtures.frames(spark)[0], "validate").select("unit_id", "name", "qualname")


@query(f"WITH {_SQL_CTES} SELECT unit_id, name FROM units WHERE parent_id = (SELECT parent_id FROM units WHERE name = 'is_expired')")
def siblings(spark, d):
    u = fixtures.frames(spark)[0]
    unit = fixtures.unit("is_expired")
    return graph.siblings(u, unit).select("unit_id", "name")


@query(f"WITH {_SQL_CTES} SELECT unit_id, name FROM units WHERE parent_id = (SELECT unit_id FROM units WHERE name = 'TokenValidator')")
def children(spark, d):
    return graph.children(fixtures.frames(spark)[0], fixtures.unit("TokenValidator")).select("unit_id", "name")


@query(f"WITH {_SQL_CTES} SELECT edge_id, callee, line FROM edges WHERE caller_unit_id = (SELECT unit_id FROM units WHERE name = 'login')")
def callees(spark, d):
    return graph.callees(fixtures.frames(spark)[1], fixtures.unit("login")).select("edge_id", "callee", "line")


def _part_links(spark, d) -> DataFrame:
    """Parts that follow each other in an order, as calls from one part to the next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).filter("b IS NOT NULL").distinct()


@query("""WITH link AS (SELECT DISTINCT l_partkey AS a, b FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL),
h1 AS (SELECT DISTINCT a FROM link WHERE b = 1), h2 AS (SELECT DISTINCT a FROM link WHERE b IN (SELECT a FROM h1) AND a NOT IN (SELECT a FROM h1)),
h3 AS (SELECT DISTINCT a FROM link WHERE b IN (SELECT a FROM h2) AND a NOT IN (SELECT a FROM h1) AND a NOT IN (SELECT a FROM h2))
SELECT hop, count(*) AS parts, sum(a)::BIGINT AS keys FROM (SELECT 1 AS hop, a FROM h1 UNION ALL SELECT 2, a FROM h2 UNION ALL SELECT 3, a FROM h3) GROUP BY hop""")
def transitive_parts(spark, d):
    """The same traversal over a larger graph, by key."""
    links = _part_links(spark, d).select(F.col("a").alias("caller_unit_id"), F.col("b").cast("string").alias("callee"), F.col("b").cast("string").alias("callee_full"), F.lit(None).cast("long").alias("callee_unit_id"), F.lit(0).cast("long").alias("file_id"), F.lit(1).alias("line"))
    key = F.col("p_partkey").cast("string")
    units = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.lit(0).cast("long").alias("file_id"), key.alias("name"), key.alias("qualname"), F.lit("symbol").alias("kind"), F.lit("function").alias("unit_type"), F.lit("p").alias("file_path"))
    return graph.transitive("1", links, units, 3).groupBy("hop").agg(F.count(F.lit(1)).alias("parts"), F.sum("unit_id").alias("keys"))


# -- statistics, snapshots -----------------------------------------------------------------------------------------


@query("SELECT n_name, count(c_custkey) AS unit_count FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 5000 GROUP BY n_name")
def list_files(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return table(spark, d, "nation").join(c, "n_nationkey", "left").groupBy("n_name").agg(F.count("c_custkey").alias("unit_count"))


@query("SELECT lang, count(*) AS units, count(DISTINCT source) AS files, sum(length(text))::BIGINT AS size FROM documents GROUP BY lang")
def index_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("source").alias("files"), F.sum(F.length("text")).cast("long").alias("size"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_stats(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def _edited(docs: DataFrame) -> DataFrame:
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs.filter("doc_id % 11 != 0").select("doc_id", F.sha2(t.cast("binary"), 256).alias("sha256")).union(docs.filter("doc_id % 50 = 1").select(F.col("doc_id") + 10_000_000, F.sha2(F.col("text").cast("binary"), 256)))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


_SQL_EDITED = """a AS (SELECT doc_id, sha256(text) AS s FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS s FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 10000000, sha256(text) FROM documents WHERE doc_id % 50 = 1)"""


@query(f"WITH {_SQL_EDITED} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def snapshot_diff(spark, d):
    docs = table(spark, d, "documents")
    return snapshot.diff(_hashed(docs), _edited(docs), "doc_id")


@query(f"WITH {_SQL_EDITED} SELECT a.doc_id, (b.s IS NULL OR b.s <> a.s) AS stale FROM a LEFT JOIN b ON a.doc_id = b.doc_id")
def stale_flags(spark, d):
    docs = table(spark, d, "documents")
    return snapshot.stale(_hashed(docs), _edited(docs), "doc_id")


@query("SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INTEGER AS ordinal FROM documents")
def stable_ids(spark, d):
    return snapshot.stable_ids(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id").drop("id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND text <> ''")
def missing_embeddings(spark, d):
    docs = table(spark, d, "documents").filter("text != ''").select("doc_id", "lang")
    return snapshot.missing(docs, table(spark, d, "embeddings"), "doc_id", "vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphans(spark, d):
    return snapshot.missing(table(spark, d, "embeddings").select("vec_id"), table(spark, d, "documents").filter("doc_id % 3 != 0"), "vec_id", "doc_id")


@query("SELECT o.o_orderkey, o.o_orderpriority FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def semi_join_edges(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY l_partkey")
def callers_concat(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


# -- evaluation ----------------------------------------------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    """A question per order: its parts of one flag are the gold, all its parts by price the hits."""
    lines = table(spark, d, "lineitem")
    hits = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber", "l_partkey"))), 1, 20), lambda x: x["l_partkey"])
    gold = F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))))
    return lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(gold.alias("gold"), hits.alias("hits")).withColumn("gold_hops", F.map_from_entries(F.transform("gold", lambda g: F.struct(g, (g % 3 + 1).cast("int")))))


_SQL_METRICS = """WITH h AS (SELECT l_orderkey AS query_id, list(l_partkey ORDER BY -l_extendedprice, l_linenumber)[1:5] AS top, list_sort(coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R'), [])) AS gold FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, len(list_intersect(gold, list_distinct(top))) AS f, list_filter(gold, lambda g: g % 3 + 1 >= 2) AS far, list_min(list_filter([CASE WHEN list_contains(gold, top[i]) THEN i END FOR i IN range(1, len(top) + 1)], lambda x: x IS NOT NULL)) AS r FROM h)
SELECT query_id, round(CASE WHEN len(gold) > 0 THEN f::DOUBLE / len(gold) ELSE 0 END, 6) AS unit_recall, round(CASE WHEN len(top) > 0 THEN f::DOUBLE / len(list_distinct(top)) ELSE 0 END, 6) AS precision,
round(CASE WHEN len(far) > 0 THEN len(list_intersect(far, list_distinct(top)))::DOUBLE / len(far) END, 6) AS indirect_recall, round(coalesce(1.0::DOUBLE / r, 0), 6) AS mrr FROM m"""


@query(_SQL_METRICS)
def retrieval_metrics(spark, d):
    out = evaluate.metrics(_runs(spark, d), 5)
    return out.select("query_id", *(r6(c).alias(c) for c in ("unit_recall", "precision", "indirect_recall", "mrr")))


@query(f"SELECT round(avg(unit_recall), 4) AS unit_recall, round(coalesce(avg(indirect_recall), 0), 4) AS indirect_recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, count(*) AS n FROM ({_SQL_METRICS})")
def metrics_summary(spark, d):
    out = evaluate.summary(evaluate.metrics(_runs(spark, d), 5), ["unit_recall", "indirect_recall", "precision", "mrr"])
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("unit_recall", "indirect_recall", "precision", "mrr")))


@query("""WITH s AS (SELECT o_orderpriority AS system, round(avg(o_totalprice), 4) AS price, count(*)::DOUBLE AS orders FROM orders GROUP BY 1)
SELECT system, 'price' AS metric, price AS value FROM s WHERE price = (SELECT max(price) FROM s) UNION ALL SELECT system, 'orders', orders FROM s WHERE orders = (SELECT min(orders) FROM s)""")
def best_cells(spark, d):
    scores = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("system")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))
    return evaluate.best_cells(scores, "system", {"price": True, "orders": False})


_SQL_REPORT = "SELECT o_orderpriority AS system, round(avg(o_totalprice), 4) AS price, count(*)::DOUBLE AS orders FROM orders WHERE o_orderstatus = '%s' GROUP BY 1"


@query(f"""WITH a AS ({_SQL_REPORT % 'F'} HAVING o_orderpriority <> '5-LOW'), b AS ({_SQL_REPORT % 'O'}), j AS (SELECT coalesce(a.system, b.system) AS system, a.price AS p0, b.price AS p1, a.orders AS o0, b.orders AS o1 FROM a FULL JOIN b ON a.system = b.system)
SELECT system, 'price' AS metric, p0 AS before, p1 AS after, round(p1 - p0, 4) AS delta FROM j UNION ALL SELECT system, 'orders', o0, o1, round(o1 - o0, 4) FROM j""")
def compare_reports(spark, d):
    report = lambda status: table(spark, d, "orders").filter(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("system")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))
    out = evaluate.compare(report("F").filter("system != '5-LOW'"), report("O"), "system", ["price", "orders"])
    return out.withColumn("delta", F.round("delta", 4))


@query("SELECT o_orderpriority, median AS saving FROM (SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY o_orderpriority)")
def upper_median(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(evaluate.upper_median("o_totalprice").alias("saving"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id)::INTEGER AS place FROM documents QUALIFY place <= 25")
def seeded_sample(spark, d):
    return evaluate.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 25, 42)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], e), 5) AS score FROM embeddings, q)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 30""")
def dot_top(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id = 0").select(F.col("embedding").alias("e"))
    scored = v.crossJoin(F.broadcast(asked)).select("vec_id", F.round(search.dot(F.col("embedding"), F.col("e")), 5).alias("score"))  # one row
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(30)


@query(f"SELECT b.doc_id, b.score FROM ({_sql_bm25('documents', 'doc_id', {'text': 1.0}, 'ering pour+la Ciónes', None)}) b JOIN documents USING (doc_id) WHERE lang = 'es'")
def bm25_language(spark, d):
    """A filter on language comes after the corpus' figures, so it changes no score."""
    out = search.bm25(table(spark, d, "documents"), "doc_id", {"text": 1.0}, "ering pour+la Ciónes", None, ["lang"])
    return out.filter("lang = 'es'").select("doc_id", r6("score").alias("score"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), *evaluate.percentiles("value"))


@query("""SELECT doc_id, sum(h)::BIGINT AS hits FROM (SELECT doc_id, unnest([(contains(l, 'the'))::INTEGER + (contains(l, 'license'))::INTEGER + (contains(l, 'ción'))::INTEGER FOR l IN string_split(lower(text), chr(10))]) AS h FROM documents) GROUP BY doc_id HAVING sum(h) > 0""")
def grep_baseline(spark, d):
    return evaluate.grep(table(spark, d, "documents"), "doc_id", "text", ["the", "License", "ción"])


@query("""WITH s AS (SELECT o_custkey AS q, o_orderpriority AS system, max(o_totalprice) AS recall FROM orders GROUP BY 1, 2),
b AS (SELECT q, max(recall) FILTER (WHERE system IN ('1-URGENT', '2-HIGH')) AS a, max(recall) FILTER (WHERE system IN ('4-NOT SPECIFIED', '5-LOW')) AS b FROM s GROUP BY q)
SELECT count(*) FILTER (WHERE a - b > 1e-9) AS wins, count(*) FILTER (WHERE abs(a - b) <= 1e-9) AS ties, count(*) FILTER (WHERE a - b < -1e-9) AS losses FROM b WHERE a IS NOT NULL AND b IS NOT NULL""")
def scoreboard(spark, d):
    scores = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("system")).agg(F.max("o_totalprice").alias("recall"))
    return evaluate.scoreboard(scores, ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"])


# -- streams -------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM s GROUP BY user_id, k""")
def session_coalesce(spark, d):
    out = streams.coalesce(table(spark, d, "events"), "ts", ["user_id"], "event_type", "6 hours")
    return out.select("user_id", "first_ts", "last_ts", "n", F.array_join(F.array_sort("items"), ",").alias("kinds"))
