"""What the operators share: checkpoints, Arrow batches and a vectorised word scanner."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are scanned at a time; the scanner needs about 40 bytes of memory for each.
GROUP_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. One of our own is made only where the session names none
    and all of it runs in this process; on a cluster a machine's own folder would lose data, so that is an error."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = 1_000_000, size: int = 64_000_000) -> bool:
    """Whether df has at most so many rows, and so many bytes in strings and arrays of strings; its other columns
    should be numbers. df should be a checkpoint or a table, since its rows are counted."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    each = [F.octet_length(c) for c, k in kinds.items() if k in ("string", "binary")]
    each += [F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)) for c, k in kinds.items() if k == "array<string>"]
    n, held = df.agg(F.count(F.lit(1)), F.sum(sum((F.coalesce(x, F.lit(0)) for x in each), F.lit(0)))).first()
    return n <= rows and (held or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000, size: int = 64_000_000) -> DataFrame:
    """df, to be broadcast in a join if it is small; beyond that the join shuffles."""
    return F.broadcast(df) if small(df, rows, size) else df


def join_repeated(rows: DataFrame, right: DataFrame, key: str, copies: str, hot: int = 1000, salts: int = 16) -> DataFrame:
    """rows left-joined by key with right, which has each key once and in copies how many rows share it. Keys of over
    hot rows are joined in salted parts. right should be a checkpoint or a table."""
    # Each hot key fills over hot rows, so a million of them come with a billion rows.
    many = checkpoint(right.filter(F.col(copies) > hot).select(key, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(-1)
    left = rows.join(broadcast_if_small(many), key, "left").withColumn("__salt", salt).drop("__hot")
    parts = F.when(F.col(copies) > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))
    return left.join(right.withColumn("__salt", F.explode(parts)).drop(copies), [key, "__salt"], "left").drop("__salt")


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whatever is pickled by value."""
    return sys.modules.setdefault("_lodegraph_worker_cache", types.ModuleType("_lodegraph_worker_cache")).__dict__


def claim(owner: str) -> None:
    """Begins an operator's task in this worker: what other operators' tasks have left in its cache goes."""
    cache = worker_cache()
    if cache.get("owner") != owner:
        for k in [k for k in cache if not (isinstance(k, str) and k.startswith("__"))]:
            del cache[k]
        cache["owner"] = owner
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, since the worker stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(f.__module__)
        for b in batches:
            if b.num_rows:
                out = f(b)
                yield from [out] if isinstance(out, pa.RecordBatch) else out
                del b, out
        give_back()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and n+1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, kept by the worker; base is odd."""
    cache = worker_cache()
    have = cache.get(("powers", base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = tuple(both)
        if size <= 1 << 21:
            cache[("powers", base)] = have
    return have[0][:n], have[1][:n]


BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _tables() -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "word tables" not in cache:
        lower = np.zeros(256, np.uint8)
        for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
            lower[b] = b
        lower[0x41:0x5B] = np.arange(0x61, 0x7B)
        cache["word tables"] = lower, np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
    return cache["word tables"]


class Words:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of some rows after lower-casing A-Z, in order.

    start, end: places in the bytes; row: the row that holds the word, from 0; hash: 64 bits.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, piece: int = GROUP_BYTES):
        """Scans data[offsets[0]:offsets[-1]] in pieces that end between words, so that memory beyond the
        words themselves is bounded for texts of any length but for a single word longer than a piece."""
        lower, values = _tables()
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, stop = int(offsets[0]), int(offsets[-1])
        cuts = offsets[1:-1]
        self.lower = lower
        while at < stop:
            to = min(at + piece, stop)
            low = lower[data[at:to]]
            while to < stop:
                gaps = np.flatnonzero(low == 0)
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                    low = low[: to - at]
                    break
                to = min(to + piece, stop)
                low = lower[data[at:to]]
            inside = low != 0
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            here = cuts[(cuts > at) & (cuts < to)] - at
            if len(here):
                first[here] = inside[here]
                last[here - 1] = inside[here - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            p, q = powers(BYTE_BASE, len(low) + 1)
            total = np.empty(len(low) + 1, np.uint64)
            total[0] = 0
            v = values[low]
            v *= p[:-1]
            np.cumsum(v, out=total[1:])
            parts.append((s + at, e + at, mix((total[e] - total[s]) * q[s])))
            at = to
        zero = np.zeros(0, np.int64)
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts)) if parts else (zero, zero, np.zeros(0, np.uint64))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.data = data

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all n-grams that lie in one row, and the n-grams' hashes."""
        m = len(self.hash)
        if m < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        p, q = powers(WORD_BASE, m + 1)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(self.hash * p[:-1], out=total[1:])
        i = np.flatnonzero(self.row[: m - n + 1] == self.row[n - 1 :])
        return i, mix((total[i + n] - total[i]) * q[i] + np.uint64(n))

    def text(self, i: int, n: int = 1) -> bytes:
        """Words i to i+n, lower-cased, with one space between."""
        return b" ".join(self.lower[self.data[a:b]].tobytes() for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist()))
