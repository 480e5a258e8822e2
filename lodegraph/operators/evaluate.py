"""Retrieval quality: metrics per query, their aggregate, baselines and a scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import dot


def metrics(runs: DataFrame, top_k: int) -> DataFrame:
    """Per query (columns query_id; gold, hits: arrays of ids in rank order; gold_hops: map of id to hop):
    unit_recall, precision, indirect_recall (gold of two hops or more; null without), mrr."""
    top = F.slice("hits", 1, top_k)
    distinct = F.array_distinct(top)
    found = F.size(F.array_intersect("gold", distinct))
    far = F.map_keys(F.map_filter("gold_hops", lambda k, v: v >= 2))
    first = F.array_min(F.filter(F.transform(top, lambda h, i: F.when(F.array_contains("gold", h), i + 1)), lambda x: x.isNotNull()))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    return runs.select(
        "query_id",
        share(found, F.size("gold")).alias("unit_recall"),
        share(found, F.size(distinct)).alias("precision"),
        F.when(F.size(far) > 0, F.size(F.array_intersect(far, distinct)) / F.size(far)).alias("indirect_recall"),
        F.coalesce(1 / first, F.lit(0.0)).alias("mrr"),
    )


def file_recall(gold: Column, hits: Column, top_k: int) -> Column:
    """The share of gold files among those of the first hits; 0 without gold."""
    found = F.size(F.array_intersect(gold, F.slice(hits, 1, top_k)))
    return F.when(F.size(gold) > 0, found / F.size(F.array_distinct(gold))).otherwise(F.lit(0.0))


def summary(scores: DataFrame, columns: list[str]) -> DataFrame:
    """n and the mean of each column over queries, nulls left out; 0 where there is nothing to average."""
    return scores.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns))


def best_cells(scores: DataFrame, key: str, metrics: dict[str, bool]) -> DataFrame:
    """key, metric, value of the best of each metric, all ties; the highest is best where the metric's entry is true."""
    long = scores.unpivot([key], list(metrics), "metric", "value")
    ends = long.groupBy("metric").agg(F.max("value").alias("__hi"), F.min("value").alias("__lo"))
    high = [m for m, up in metrics.items() if up]
    best = F.when(F.col("metric").isin(*high), F.col("__hi")).otherwise(F.col("__lo")) if high else F.col("__lo")
    return long.join(F.broadcast(ends), "metric").filter(F.col("value") == best).select(key, "metric", "value")  # a row a metric


def compare(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, metric, before, after and delta over both reports; null where a report lacks the key."""
    long = lambda df, name: df.unpivot([key], metrics, "metric", name)
    return long(before, "before").join(long(after, "after"), [key, "metric"], "full_outer").withColumn("delta", F.col("after") - F.col("before"))


def upper_median(col: str) -> Column:
    """sorted[n // 2] of n values."""
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{col})")


def sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows with their place, in an order that seed and id alone decide."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), F.col(id_col)]
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def chunk_baseline(chunks: DataFrame, vector_col: str, query: Column, k: int = 5) -> DataFrame:
    """The k chunks whose vectors have the largest inner product with the query's."""
    return chunks.withColumn("score", dot(F.col(vector_col), query)).orderBy(F.col("score").desc(), *(c for c in ("doc_id", "chunk") if c in chunks.columns)).limit(k)


def percentiles(col: str) -> list[Column]:
    """p50 and p95 as order statistics: sorted[(n - 1) // 2] and sorted[ceil(0.95 n) - 1]."""
    return [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))]


def grep(rows: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """id and hits: the number of pairs of a term (four at most) and a line that holds it, case folded."""
    some = [t.lower() for t in dict.fromkeys(terms)][:4]
    line = F.transform(F.split(F.lower(text_col), "\n", -1), lambda x: sum((F.contains(x, F.lit(t)).cast("int") for t in some), F.lit(0)))
    return rows.select(id_col, F.aggregate(line, F.lit(0), lambda a, b: a + b).cast("long").alias("hits")).filter("hits > 0")


def scoreboard(scores: DataFrame, ours: list[str], theirs: list[str], tolerance: float = 1e-9) -> DataFrame:
    """wins, ties and losses over queries of the better recall of two families of systems (query_id, system, recall)."""
    side = F.when(F.col("system").isin(*ours), "a").when(F.col("system").isin(*theirs), "b")
    best = scores.withColumn("side", side).filter("side IS NOT NULL").groupBy("query_id").pivot("side", ["a", "b"]).agg(F.max("recall")).filter("a IS NOT NULL AND b IS NOT NULL")
    gap = F.col("a") - F.col("b")
    return best.agg(F.count_if(gap > tolerance).alias("wins"), F.count_if(F.abs(gap) <= tolerance).alias("ties"), F.count_if(gap < -tolerance).alias("losses"))
