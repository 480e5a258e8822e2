"""Exact top-k search by inner product: norm-bucketed retrieval.

Components x become floor(scale * x). Candidates are ordered by falling length over the whole table and cut into
blocks of at most BLOCK_VALUES components, within these into buckets of BUCKET vectors. First every query meets the
block of the longest vectors, which gives it k results, and so a least score. A block whose longest vector, at the
best angle, falls short of that score is not joined with the query at all, nor are those after it. Within a block, a
query that has k results of at least s needs a cosine of s / (|q| * longest) in a bucket. A bucket that would need
more than 1 is passed over with all after it. Where the needed cosine is high, coordinate pruning leaves only vectors
whose component at the query's largest coordinate is feasible at that cosine; otherwise length pruning leaves those
that are long enough. What is left is multiplied out in exact arithmetic.

Vectors that are null, empty or hold null or non-finite components take no part, nor do those with a null id. Only
vectors of one dimension are compared. Ties go to the smaller id. Rows that repeat an id are candidates each, and
queries once each, with the least of their vectors; a query skips candidates of its own id. Components beyond 64-bit
integers count as the last of these, and so are scores given; ranks go by the exact sums. Other columns do not matter.

Scale: neither side is broadcast or collected. Blocks of queries that need about as many blocks of candidates meet
each of these in a task of its own; only k results per query and block are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint

BLOCK_VALUES, QUERY_VALUES, BUCKET = 2_000_000, 65_536, 2048
#: From this needed cosine on, a coordinate's range is narrow enough to prune by.
COORDINATE_FROM = 0.6
_SLACK = 1 + 1e-9  # lengths are rounded
_MOST = (1 << 63) - 1


def _bytes(v: np.ndarray) -> bytes:
    """Rows of whole numbers, in as few bytes each as all of them need; the first byte tells how many."""
    lo, hi = int(v.min(initial=0)), int(v.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= lo and hi < 1 << 8 * n - 1)
    return bytes([size]) + v.astype(f"<i{size}").tobytes()


def _values(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def _pack(rows: DataFrame, values: int, least: bool = False) -> DataFrame:
    """Blocks of vectors of a dimension (columns id, v, len and, if so, least), in their order, of at most so many
    components: dim, longest, ids, v and, if so, least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            some = held.pop(dim)
            cols = {"dim": pa.array([dim], pa.int32()), "longest": pa.array([max(x[2] for x in some)], pa.float64()), "ids": pa.array([np.array([x[0] for x in some], np.int64).tobytes()], pa.binary()), "v": pa.array([_bytes(np.stack([x[1] for x in some]).astype(np.int64))], pa.binary())}
            if least:
                cols["least"] = pa.array([np.array([x[3] for x in some], np.float64).tobytes()], pa.binary())
            return pa.RecordBatch.from_pydict(cols)

        for b in batches:
            v = b.column(1).values.to_numpy(zero_copy_only=False)
            off = b.column(1).offsets.to_numpy()
            more = b.column(3).to_pylist() if least else [None] * b.num_rows
            for i, x, y, n, s in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), b.column(2).to_pylist(), more):
                dim = y - x
                held.setdefault(dim, []).append((i, v[x:y], n, s))
                if (len(held[dim]) + 1) * dim > values:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, longest double, ids binary, v binary" + ", least binary" * least)


def _best(q: np.ndarray, qi: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the ids and scores of its k best in one block, if they score no less than what is known."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    top = most(q) * most(c) * q.shape[1]
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object
    length = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ci, -length))
    c, ci, length = c[order], ci[order], length[order]
    cx = c.astype(kind)
    qx = q.astype(kind)
    ql = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    focus = np.abs(q.astype(np.float64)).argmax(1) if q.shape[1] else np.zeros(len(q), int)
    least = np.full(len(q), -np.inf) if known is None else known.copy()
    ids = [np.zeros(0, np.int64)] * len(q)
    scores = [np.zeros(0, object if kind is object else np.int64)] * len(q)
    live = np.arange(len(q))
    for b in range(0, len(c), BUCKET):
        part, pi, pl = cx[b : b + BUCKET], ci[b : b + BUCKET], length[b : b + BUCKET]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(ql[live] * pl[0] > 0, least[live] / (ql[live] * pl[0]), np.where(least[live] > 0, np.inf, -np.inf))
        live, need = live[need <= _SLACK], need[need <= _SLACK]
        if not len(live):
            break
        sharp = need >= COORDINATE_FROM
        for j, t in zip(live[sharp].tolist(), need[sharp].tolist()):
            # With component u at the focus, a unit vector's cosine is at most this.
            f = float(q[j, focus[j]]) / ql[j]
            u = part[:, focus[j]].astype(np.float64) / np.where(pl > 0, pl, 1)
            ok = np.flatnonzero(u * f + np.sqrt(np.maximum(0.0, 1 - u * u)) * np.sqrt(max(0.0, 1 - f * f)) + 1e-5 >= t)
            if len(ok):
                _merge(j, pi[ok], part[ok] @ qx[j], qi, ids, scores, least, k)
        blunt = live[~sharp]
        if len(blunt):
            # By length: the longest vectors come first, so those long enough for any query are a head of the bucket.
            with np.errstate(divide="ignore", invalid="ignore"):
                enough = float(np.where(ql[blunt] > 0, least[blunt] / ql[blunt], -np.inf).min())
            head = int(np.searchsorted(-pl, -enough / _SLACK, "right")) if enough > 0 else len(pl)
            s = qx[blunt] @ part[:head].T
            for r, j in enumerate(blunt.tolist()):
                _merge(j, pi[:head], s[r], qi, ids, scores, least, k)
    for j in range(len(q)):
        yield j, ids[j], scores[j]


def _merge(j: int, pi: np.ndarray, s: np.ndarray, qi, ids, scores, least, k: int) -> None:
    good = np.flatnonzero((s >= least[j]) & (pi != qi[j])) if np.isfinite(least[j]) else np.flatnonzero(pi != qi[j])
    if not len(good):
        return
    if len(good) > 4 * k and s.dtype != object:
        edge = np.partition(s[good], len(good) - k)[len(good) - k]
        good = good[s[good] >= edge]
    a = np.concatenate([ids[j], pi[good]])
    x = np.concatenate([scores[j], s[good].astype(scores[j].dtype)])
    order = np.lexsort((a, -x))[:k]
    ids[j], scores[j] = a[order], x[order]
    if len(order) == k:
        least[j] = float(x[order[-1]])


def _sortable(x: int) -> str:
    """Text that orders as the whole number does."""
    return f"1{x:0100d}" if x >= 0 else f"0{10**100 + x:0100d}"


def _met(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and exact (orders those beyond 64 bits), from rows of a block of queries and one of
    candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, qi, qv, least, ci, cv in zip(*(c.to_pylist() for c in b.columns)):
                qi, ci = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                a, i, s = [], [], []
                for j, ids, scores in _best(_values(qv, dim), qi, _values(cv, dim), ci, k, None if least is None else np.frombuffer(least, np.float64)):
                    a.append(np.full(len(ids), qi[j]))
                    i.append(ids)
                    s.extend(scores.tolist())
                clipped = [max(min(x, _MOST), -_MOST - 1) for x in s]
                wide = [_sortable(x) if x >= _MOST or x < -_MOST else None for x in s]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.concatenate(a)), "id": pa.array(np.concatenate(i)), "score": pa.array(clipped, pa.int64()), "exact": pa.array(wide, pa.string())})

    return pairs.select("dim", "qi", "qv", "least", "ids", "v").mapInArrow(run, "query_id bigint, id bigint, score bigint, exact string")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k largest inner products of each query row with other rows."""
    if k < 1:
        raise ValueError("k has to be 1 at least")

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
        good = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
        return df.filter(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    rows = whole(vectors).withColumn("len", length)
    ordered = rows.repartitionByRange(F.size("v"), F.col("len").desc()).sortWithinPartitions(F.size("v"), F.col("len").desc())
    # Numbered when written, so they stay the same.
    blocks = checkpoint(_pack(ordered, BLOCK_VALUES)).withColumn("block", F.monotonically_increasing_id())
    by_length = Window.partitionBy("dim").orderBy(F.col("longest").desc(), "block")
    ranks = checkpoint(blocks.select("dim", "block", "longest").withColumn("place", F.row_number().over(by_length)))
    asked = checkpoint(whole(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("len", length))

    heads = blocks.join(broadcast_if_small(ranks.filter("place = 1").select("block")), "block", "left_semi").drop("block", "longest")
    packed = _pack(asked, QUERY_VALUES).select("dim", F.col("ids").alias("qi"), F.col("v").alias("qv"), F.lit(None).cast("binary").alias("least"))
    # As many rows as there are dimensions.
    first = checkpoint(_met(packed.join(heads, "dim"), k))
    # Written scores are clipped; a clipped one is as good a bound.
    known = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
    wanted = asked.join(known, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = _met(pairs(wanted, blocks, ranks), k)
    found = first.unionByName(rest)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("exact").desc(), F.col("id"))
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def pairs(wanted: DataFrame, blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Blocks of queries (id, v, len, least) with each block of candidates but the first that may score enough for
    one of them: those whose longest vectors are of least / len at least, which are the first so many by length."""
    begins = ranks.select("dim", F.col("longest").alias("at"), "place")
    need = F.when(F.col("least") == float("-inf"), float("-inf")).when(F.col("len") > 0, F.col("least") / F.col("len") / _SLACK).otherwise(F.when(F.col("least") > 0, float("inf")).otherwise(float("-inf")))
    asks = wanted.select(F.size("v").alias("dim"), need.alias("at"), "id")
    # Lengths in steps of a thousandth of their logarithm, downwards: a few ten thousand at most, whatever the blocks.
    step = F.when(F.col("at") > 0, F.floor(F.log("at") * 1000)).otherwise(F.lit(-(10**9)))
    upto = begins.withColumn("step", step).groupBy("dim", "step").agg(F.max("place").alias("place"))
    total = Window.partitionBy("dim").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = upto.withColumn("place", F.max("place").over(total))
    bound = upto.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("s"), "place"))).alias("steps"))
    last = F.coalesce(F.array_max(F.transform(F.filter("steps", lambda x: -x["s"] >= F.col("step")), lambda x: x["place"])), F.lit(0))
    needed = asks.withColumn("step", step).join(F.broadcast(bound), "dim").select("id", last.alias("last")).filter("last > 1")
    some = wanted.join(needed, "id")
    packed = _pack(some.repartitionByRange("last").sortWithinPartitions("last").select("id", "v", F.col("last").cast("double").alias("len"), "least"), QUERY_VALUES, True)
    packed = packed.select("dim", F.col("ids").alias("qi"), F.col("v").alias("qv"), "least", F.explode(F.sequence(F.lit(2), F.col("longest").cast("int"))).alias("place"))
    return packed.join(ranks.select("dim", "place", "block"), ["dim", "place"]).drop("dim").join(blocks.drop("longest"), "block")
