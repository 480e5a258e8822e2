"""The index as a user asks it: every method gives a DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Embedder, Index
from .operators import graph, route, search, snapshot, spans

WEIGHTS = {"name": 10.0, "qualname": 8.0, "signature": 4.0, "summary": 2.0, "file_path": 1.0}
_ASKS_WHERE = re.compile(r"where\s+is|defin(?:ed|ition)", re.I)
_DEEP = re.compile(r"transitive|indirect|blast radius|downstream|what breaks", re.I)


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    rrf_k: int = 60
    max_evidence_tokens: int = 1500
    candidates: int = 30
    per_file: int = 3


def exact_words(query: str) -> list[str]:
    """Identifiers in a query, lower-cased, and their parts: words with an underscore, dot, colon or dollar sign, of
    mixed case or in capitals; any but common words if the query asks where something is defined."""
    out = []
    for w in (x.strip("?.,()[]:") for x in query.split()):
        telling = re.search(r"[_.:$]", w) or w[1:].lower() != w[1:] or len(w) > 1 and w.isupper()
        if w and (telling or _ASKS_WHERE.search(query) and w.lower() not in route._SKIP and not _ASKS_WHERE.fullmatch(w)):
            out += [w.lower(), *(p.lower() for p in re.split(r"[.:$]+", w) if p)]
    return list(dict.fromkeys(out))


class Engine:
    def __init__(self, index: Index, embedder: Embedder | None = None, config: Config = Config()):  # noqa: B008
        self.index, self.embedder, self.config = index, embedder, config
        self.spark = index.spark

    def _t(self, name: str) -> DataFrame:
        return self.index.table(name)

    # -- search --

    def lexical(self, query: str, limit: int = 30, language: str | None = None, exact: bool = False) -> DataFrame:
        """unit_id, score, lexical_rank. Filters come after the corpus' figures, so they change no score."""
        where = F.lit(True) if language is None else F.col("language") == language
        if exact:
            where = where & ((F.col("name") == query) | (F.col("qualname") == query) | (F.col("file_path") == query))
        all_rows = search.bm25(self._t("units"), "unit_id", WEIGHTS, query, None, ["language", "name", "qualname", "file_path"])
        best = all_rows.filter(where).select("unit_id", "score").orderBy("score", "unit_id").limit(limit)
        return best.withColumn("lexical_rank", F.row_number().over(Window.orderBy("score", "unit_id")))  # limit rows

    def dense(self, query: str, limit: int = 30, language: str | None = None) -> DataFrame:
        if self.embedder is None:
            return self.spark.createDataFrame([], "unit_id long, distance double, dense_rank int")
        where = None if language is None else F.col("language") == language
        return search.knn(self._t("vectors"), "unit_id", "embedding", self.embedder.embed([query])[0], limit, where)

    def search(self, query: str, top_k: int | None = None, mode: str = "hybrid", language: str | None = None, query_class: str | None = None) -> DataFrame:
        """unit_id, score, lexical_rank, dense_rank, hop and the unit's own columns, mode, class, budget_tokens and
        stale, best first. An impact question about a symbol goes to its callers; if it has none, on to the text."""
        c = self.config
        kind = query_class or self.spark.range(1).select(route.classify(F.lit(query))).first()[0]
        tokens, class_k = route.BUDGETS.get(kind, route.BUDGETS["local"])
        k, tokens = top_k or min(class_k, c.top_k), min(tokens, c.max_evidence_tokens)
        name = route.impact_symbol(query) if kind == "impact" else None
        if name:
            depth = 3 if _DEEP.search(query) else 1
            found = self.callers(name, depth, max(3 * k, 10))
            if not found.isEmpty():
                return self._named(found.withColumn("score", F.lit(1.0)), k, "calls", kind, tokens, [F.col("hop"), F.col("unit_id")])
        if mode == "hybrid" and kind == "symbol":
            mode = "lexical"
        if mode == "lexical":
            found = self.lexical(query, c.candidates, language, exact=kind == "symbol")
            if kind == "symbol" and found.isEmpty():
                found = self.lexical(query, c.candidates, language)
            order = [F.col("score"), F.col("unit_id")]
        elif mode == "dense":
            found = self.dense(query, c.candidates, language).withColumn("score", -F.col("distance")).drop("distance")
            order = [F.col("score").desc(), F.col("unit_id")]
        elif mode == "hybrid":
            lexical = self.lexical(query, c.candidates, language)
            words = exact_words(query)
            units = self._t("units").select("unit_id", "kind", F.array("name", "qualname", F.element_at(F.split("file_path", "/"), -1), "file_path").alias("__names"))
            lexical = lexical.join(units, "unit_id").withColumn("__exact", (F.col("kind") == "symbol") & F.exists("__names", lambda x: F.lower(x).isin(*words) if words else F.lit(False)))
            bonus = lexical.filter("__exact").select("unit_id", F.lit(True).alias("__hit"))
            found = search.rrf(lexical, self.dense(query, c.candidates, language), "unit_id", c.rrf_k)
            found = found.join(F.broadcast(bonus), "unit_id", "left").withColumn("score", F.col("score") + F.when(F.col("__hit"), 1.0 / (c.rrf_k + 1)).otherwise(0.0)).drop("__hit")  # candidates at most
            order = [*search.rrf_order(), F.col("unit_id")]
        else:
            raise ValueError(f"mode {mode!r} is none of lexical, dense, hybrid")
        return self._named(found, k, mode, kind, tokens, order)

    def _named(self, found: DataFrame, k: int, mode: str, kind: str, tokens: int, order: list) -> DataFrame:
        for c, t in (("lexical_rank", "int"), ("dense_rank", "int"), ("hop", "int")):
            if c not in found.columns:
                found = found.withColumn(c, F.lit(None).cast(t))
        named = found.select("unit_id", "score", "lexical_rank", "dense_rank", "hop").join(self._t("units").withColumnRenamed("kind", "unit_kind"), "unit_id")
        best = search.cap_per_group(named, order, ["file_path"], self.config.per_file, k, ["file_path", "qualname", "start_line"])
        return best.withColumn("mode", F.lit(mode)).withColumn("class", F.lit(kind)).withColumn("budget_tokens", F.lit(tokens)).orderBy(*order)

    @staticmethod
    def packets(found: DataFrame) -> DataFrame:
        """json: each result as an object; what a result doesn't have is left out."""
        some = [F.col("unit_id"), F.round("score", 4).alias("score"), "qualname", "unit_type", "file_path", F.array("start_line", "end_line").alias("lines"), F.when(F.col("lexical_rank").isNotNull() | F.col("dense_rank").isNotNull(), F.struct(F.col("lexical_rank").alias("lexical"), F.col("dense_rank").alias("dense"))).alias("ranks"), "hop"]
        return found.select(F.to_json(F.struct(*some)).alias("json"))

    # -- graph --

    def callers(self, name: str, depth: int = 1, limit: int = 50) -> DataFrame:
        """unit_id, line, call, resolved_target, hop: calls outside tests first, then by line and file."""
        u, e, a = self._t("units"), self._t("edges"), self._t("aliases")
        if depth > 1:
            found = graph.transitive(name, e, u, depth).withColumn("line", F.lit(None).cast("int")).withColumn("call", F.lit(None).cast("string")).withColumn("resolved_target", F.lit(None).cast("string"))
        else:
            found = graph.callers(self.spark.createDataFrame([(name,)], "target string").filter("target != ''"), e, u, a).withColumn("hop", F.lit(0))
        named = found.join(u.select("unit_id", "file_path"), "unit_id")
        order = [F.col("hop"), F.contains(F.lower("file_path"), F.lit("test")), F.col("line"), F.col("file_path"), F.col("unit_id")]
        return named.orderBy(*order).limit(limit).select("unit_id", "line", "call", "resolved_target", "hop")

    def callees(self, unit_id: int) -> DataFrame:
        return graph.callees(self._t("edges"), unit_id)

    def resolve(self, name: str, limit: int = 10) -> DataFrame:
        return graph.resolve(self._t("units"), name, limit)

    def dependents(self, target: str, limit: int = 50) -> DataFrame:
        return graph.importers(self._t("units"), self._t("aliases").drop("file_path"), self._t("files"), target, limit)

    def children(self, unit_id: int) -> DataFrame:
        return graph.children(self._t("units"), unit_id)

    def siblings(self, unit_id: int) -> DataFrame:
        return graph.siblings(self._t("units"), unit_id)

    # -- files and evidence --

    def list_files(self, language: str | None = None) -> DataFrame:
        files = self._t("files") if language is None else self._t("files").filter(F.col("language") == language)
        units = self._t("units").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
        return files.join(units, "file_id", "left").select("path", "language", "kind", F.coalesce("n", F.lit(0)).alias("unit_count")).orderBy("path")

    def list_symbols(self, path: str) -> DataFrame:
        return self._t("units").filter(F.col("file_path") == path).orderBy("start_line", "start_col", "unit_id")

    def read_file(self, path: str, first: int = 1, last: int = 1 << 30) -> DataFrame:
        """path, text of the lines (from 1, both included, clamped) and total_lines; no path leads out of the index."""
        if path.startswith(("/", "~")) or ".." in path.split("/"):
            raise ValueError(f"{path!r} leads out of the root")
        t = F.col("text")
        return self._t("files").filter(F.col("path") == path).select("path", spans.read_lines(t, first, min(last, 1 << 30)).alias("text"), F.size(spans.lines(t)).alias("total_lines"))

    def get_many(self, ids: list[int], max_tokens: int | None = None, current: DataFrame | None = None) -> DataFrame:
        """unit_id, file_path, evidence (the unit's lines as they are now), truncated, stale: in the order of the ids;
        ids without a unit drop out. current: path, sha256 and text of the files as they are; else as indexed."""
        asked = self.spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "unit_id long, n int")
        files = self._t("files").select("path", "sha256")
        now = (self._t("files") if current is None else current).select("path", F.col("text").alias("__now"))
        stale = snapshot.stale(files, self._t("files") if current is None else current, "path")
        rows = self._t("units").join(F.broadcast(asked), "unit_id").join(stale, F.col("file_path") == stale["path"]).drop("path").join(now, F.col("file_path") == now["path"], "left")  # as many as asked for
        text = F.array_join(F.slice(spans.lines(F.col("__now")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
        share = None if max_tokens is None else route.evidence_share(max_tokens, len(ids))
        cut = text if share is None else spans.fit_evidence(text, share)
        return rows.select("n", "unit_id", "file_path", cut.alias("evidence"), (F.coalesce(cut != text, F.lit(False))).alias("truncated"), "stale").orderBy("n").drop("n")
