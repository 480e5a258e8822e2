"""Lexical and dense search, fusion of ranked lists and caps per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences, query_phrases, tokens


def bm25(rows: DataFrame, id_col: str, weights: dict[str, float], query: str, limit: int | None = 30, keep: list[str] | None = None) -> DataFrame:
    """id, score (lower is better) and lexical_rank of the best rows for any of the query's phrases.

    One scan counts the phrases in place, without exploding tokens; corpus figures are one aggregated row. k1 is 1.2
    and b 0.75; a phrase in more than half of the rows has the least positive weight, 1e-6. Ties go to the smaller id.
    """
    keep = keep or []
    phrases = query_phrases(query)
    # Each column's tokens are bound once as a lambda's variable; all counts are read off them.
    counts = [
        F.transform(F.array(tokens(F.col(c))), lambda t: F.array(F.size(t), *(occurrences(t, p) for p in phrases)))[0].alias(f"c{i}")
        for i, c in enumerate(weights)
    ]
    total = lambda k, w: sum((F.lit(w(c)) * F.col(f"c{i}")[k] for i, c in enumerate(weights)), F.lit(0.0 if k else 0))
    counted = rows.select(id_col, *keep, *counts)
    hits = counted.select(id_col, *keep, total(0, lambda c: 1).alias("len"), *(total(k + 1, lambda c: float(weights[c])).alias(f"f{k}") for k in range(len(phrases))))
    if not phrases:
        return hits.filter(F.lit(False)).select(id_col, *keep, F.lit(0.0).alias("score"), F.lit(1).alias("lexical_rank"))
    stats = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(phrases))))
    both = hits.filter(sum((F.col(f"f{k}") for k in range(len(phrases))), F.lit(0.0)) > 0).crossJoin(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for k in range(len(phrases)):
        idf = F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        score = score + idf * F.col(f"f{k}") * 2.2 / (F.col(f"f{k}") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    out = both.select(id_col, *keep, (-score).alias("score"))
    if limit is None:
        return out
    out = out.orderBy("score", id_col).limit(limit)
    return out.withColumn("lexical_rank", F.row_number().over(Window.orderBy("score", id_col)))  # limit rows at most


def l2_distance(a: Column, b: list[float]) -> Column:
    other = F.array(*(F.lit(float(x)) for x in b))
    return F.sqrt(F.aggregate(F.zip_with(a, other, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], limit: int = 30, where: Column | None = None) -> DataFrame:
    """id, distance and dense_rank of the nearest vectors by exact scan; where filters first."""
    rows = vectors if where is None else vectors.filter(where)
    out = rows.filter(F.size(vector_col) == len(query)).select(id_col, l2_distance(F.col(vector_col), query).alias("distance")).orderBy("distance", id_col).limit(limit)
    return out.withColumn("dense_rank", F.row_number().over(Window.orderBy("distance", id_col)))  # limit rows at most


def rrf(lexical: DataFrame, dense: DataFrame, id_col: str, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), bonus: Column | None = None) -> DataFrame:
    """id, lexical_rank, dense_rank and score: the sum of weight / (k + rank) over both lists, and a bonus. Equal
    scores keep the order of the lists, the lexical one first."""
    both = lexical.select(id_col, "lexical_rank").join(dense.select(id_col, "dense_rank"), id_col, "full_outer")
    part = lambda rank, w: F.coalesce(F.lit(w) / (k + F.col(rank)), F.lit(0.0))
    score = part("lexical_rank", weights[0]) + part("dense_rank", weights[1])
    if bonus is not None:
        score = score + F.when(bonus, 1.0 / (k + 1)).otherwise(0.0)
    return both.withColumn("score", score)


def rrf_order() -> list[Column]:
    return [F.col("score").desc(), F.col("lexical_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last()]


def cap_per_group(rows: DataFrame, order: list, group: list[str], cap: int, limit: int, same: list[str] | None = None) -> DataFrame:
    """The first of rows that agree in same, then at most cap rows of each group, then limit rows, by order."""
    if same:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).filter("__n = 1").drop("__n")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= cap).drop("__n")
    return rows.orderBy(*order).limit(limit)
