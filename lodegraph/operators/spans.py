"""As-of, containment and section operators over spans, chunks and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_map(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, span_id: str) -> DataFrame:
    """points with the span_id of the latest-started span of their key at or before them, where it still covers them
    (start <= at < end); other points are dropped. Spans that start together: the greatest id is the latest.

    Points and spans are merged in one ordered window per key, so the join needs a single shuffle."""
    names = [c for c in points.columns if c not in (key, at)]
    p = points.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__tag"), F.struct(F.col(at), *names).alias("__p"), F.lit(None).cast("struct<s:string>").alias("__x")).drop("__x")
    s = spans.select(F.col(key), F.col(start).alias("__t"), F.lit(0).alias("__tag"), F.struct(F.col(end).alias("e"), F.col(span_id).alias("i")).alias("__s"))
    both = p.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__tag", F.col("__s.i").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__s", ignorenulls=True).over(w)).filter((F.col("__tag") == 1) & (F.col("__t") < F.col("__last.e")))
    return out.select(key, "__p.*", F.col("__last.i").alias(span_id))


def containment_parent(units: DataFrame, key: str, unit_id: str, start: str, end: str) -> DataFrame:
    """units with parent_id: the smallest strictly larger unit of the same key whose span contains theirs."""
    big = units.select(F.col(key).alias("k"), F.col(unit_id).alias("p"), F.col(start).alias("ps"), F.col(end).alias("pe"))
    hit = units.join(big, (F.col(key) == F.col("k")) & (F.col("ps") <= F.col(start)) & (F.col("pe") >= F.col(end)) & ((F.col("pe") - F.col("ps")) > (F.col(end) - F.col(start))))
    best = hit.groupBy(unit_id).agg(F.min_by("p", F.struct(F.col("pe") - F.col("ps"), F.col("p"))).alias("parent_id"))
    return units.join(best, unit_id, "left")


def smallest_container(points: DataFrame, units: DataFrame, key: str, at: str, point_id: list[str], unit_id: str, start: str, end: str) -> DataFrame:
    """points with the smallest unit that holds them, both ends included; ties go to the smaller id."""
    u = units.select(F.col(key), F.col(unit_id), F.col(start).alias("__s"), F.col(end).alias("__e"))
    hit = points.join(u, key).filter((F.col("__s") <= F.col(at)) & (F.col("__e") >= F.col(at)))
    return hit.groupBy(key, *point_id, at).agg(F.min_by(unit_id, F.struct(F.col("__e") - F.col("__s"), F.col(unit_id))).alias(unit_id))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(rows: DataFrame, id_col: str, text_col: str, size: int = 600) -> DataFrame:
    """id, chunk (from 0), start (characters) and text of pieces of at most size characters."""
    n = F.length(text_col)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = rows.select(id_col, F.col(text_col).alias("__t"), F.explode(at).alias("chunk"))
    return out.select(id_col, "chunk", (F.col("chunk") * size).alias("start"), F.substring("__t", F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def trim_to_budget(text: Column, max_tokens: int) -> Column:
    """The whole leading lines that fit in four characters a token, counting line ends."""
    room = max_tokens * 4
    acc = F.aggregate(
        lines(text),
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept")),
        lambda a, x: F.struct((a["used"] + F.length(x) + 1).alias("used"), F.when(a["used"] + F.length(x) + 1 <= room, a["kept"] + 1).otherwise(a["kept"]).alias("kept")),
    )
    return F.array_join(F.slice(lines(text), 1, acc["kept"]), "\n")


NOTE = "\n... (cut to the budget)"


def fit_evidence(text: Column, max_tokens: int, note: str = NOTE) -> Column:
    """The text if it fits; else its whole leading lines that fit, with a note if that fits as well."""
    room = max_tokens * 4
    kept = trim_to_budget(text, max_tokens)
    return F.when(F.length(text) <= room, text).when(F.length(kept) + len(note) <= room, F.concat(kept, F.lit(note))).otherwise(kept)


def read_lines(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, both included, clamped to the text."""
    return F.array_join(F.slice(lines(text), max(first, 1), max(0, last - max(first, 1) + 1)), "\n")


def sections(rows: DataFrame, id_col: str, line_col: str, order_col: str, heading: Column) -> DataFrame:
    """rows with section: how many headings have come so far in the document, by a running sum."""
    w = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(heading.cast("int")).over(w))
