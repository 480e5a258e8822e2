"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, scanned over documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is n consecutive words of an
item; an item of fewer words, but not none, is one window. Each place of a document whose hash is in the set is
verified word by word before it counts.

Nulls and empty texts have no words and are never hit; items with a null item_id or without words are left out;
rows of one item_id count as one item; repeated document rows each get their own result; without items nothing
is hit. Columns of the documents other than the text pass through untouched, whatever their names.

Scale: the scan is one pass over the documents without a shuffle if the benchmark has at most BLOCK_WORDS words, by its
bytes: then its windows are broadcast. A larger one stays a table of windows, and what is broadcast is a bitmap of
their hashes, of a fixed size: documents' places that pass it are joined with the table, with their words, and what is
verified comes back to its document. Either way gives the same rows; neither grows faster than the documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpoint, groups, join_repeated, map_batches, utf8, worker_cache

#: Item words in the broadcast set, of ten bytes; about 150 bytes of worker memory each.
BLOCK_WORDS = 1_000_000
#: The bitmap has 2**BITS bits, in parts of 2**PART bytes.
BITS, PART = 28, 16


class WindowSet:
    """The windows of the items by length: a bitmap and sorted hashes to scan with, and the words to verify."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.windows: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for name, text in items:
            w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            size = min(n, len(w.hash))
            if size:
                for i, h in zip(*(x.tolist() for x in w.ngrams(size))):
                    self.windows[size][h][w.text(i, size)].add(name)
        self.windows = {k: {h: dict(t) for h, t in v.items()} for k, v in self.windows.items()}
        self.sorted = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in self.windows.items()}
        self.bits = {}
        for k, v in self.sorted.items():
            self.bits[k] = np.zeros(1 << 20, bool)
            self.bits[k][v >> np.uint64(44)] = True

    def hits(self, w: Words):
        """(place of the first word, length, items) of each verified hit."""
        for size, known in self.sorted.items():
            i, h = w.ngrams(size)
            near = np.flatnonzero(self.bits[size][h >> np.uint64(44)])
            if not len(near):
                continue
            at = np.minimum(np.searchsorted(known, h[near]), len(known) - 1)
            near = near[known[at] == h[near]]
            for a, b in zip(i[near].tolist(), h[near].tolist()):
                names = self.windows[size][b].get(w.text(a, size))
                if names:
                    yield a, size, names


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(_q(id_col)).cast("string").alias("i"), F.col(_q(text_col)).cast("binary").alias("t"))
    return rows.filter("i IS NOT NULL AND t IS NOT NULL")


def _windows(items: DataFrame, n: int) -> DataFrame:
    """size, h (hash), w (words) and i (item) of all windows, each once, as a checkpoint."""

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        data, off = utf8(b.column(1))
        for r in range(b.num_rows):
            w = Words(data, off[r : r + 2])
            size = min(n, len(w.hash))
            if size:
                i, h = w.ngrams(size)
                m = len(i)
                text = [w.text(x, size) for x in i.tolist()]
                out.append(pa.RecordBatch.from_pydict({"size": pa.array([size] * m, pa.int32()), "h": pa.array(h.view(np.int64)), "w": pa.array(text, pa.binary()), "i": pa.array([b.column(0)[r].as_py()] * m, pa.string())}))
        return out

    return checkpoint(map_batches(items.select("i", "t"), run, "size int, h bigint, w binary, i string").distinct())


def _bitmap(windows: DataFrame) -> np.ndarray:
    """2**BITS bits, of which those are set that the first bits of the windows' hashes name. Its parts are made on the
    executors."""
    part_bits = PART + 3

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            place = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
            for p in np.unique(place >> part_bits).tolist():
                bits = parts.setdefault(p, np.zeros(1 << part_bits, bool))
                bits[place[place >> part_bits == p] & ((1 << part_bits) - 1)] = True
        for p, bits in parts.items():
            yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    part = F.shiftrightunsigned("h", 64 - BITS + part_bits)
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in windows.select("h").distinct().repartition(part).mapInArrow(run, "p int, bits binary").toLocalIterator():
        at = r.p << PART
        out[at : at + (1 << PART)] |= np.frombuffer(r.bits, np.uint8)
    return out


def _hits_by_text(docs: DataFrame, items: DataFrame, text_col: str, n: int) -> DataFrame:
    """key (digest of the text), n_rows (rows with it), places (array of place and size, of its words that begin a
    window) and names (items) of the texts with verified hits, as a checkpoint."""
    windows = _windows(items, n)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(windows))

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        data, off = utf8(b.column(1))
        bits = shared.value
        for x, y in groups(off):
            w = Words(data, off[x : y + 1])
            first = np.searchsorted(w.row, np.arange(y - x))
            for size in sizes:
                i, h = w.ngrams(size)
                at = (h >> np.uint64(64 - BITS)).astype(np.int64)
                near = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                if len(near):
                    row = w.row[i[near]]
                    key = pa.DictionaryArray.from_arrays(pa.array(row + x), b.column(0)).cast(pa.binary())
                    text = [w.text(k, size) for k in i[near].tolist()]
                    out.append(pa.RecordBatch.from_pydict({"key": key, "place": pa.array(i[near] - first[row]), "size": pa.array([size] * len(near), pa.int32()), "h": pa.array(h[near].view(np.int64)), "w": pa.array(text, pa.binary())}))
        return out

    t = F.col(text_col)
    near = map_batches(docs.select(F.unhex(F.md5(t.cast("binary"))).alias("key"), t.alias("t")).filter("t IS NOT NULL"), run, "key binary, place bigint, size int, h bigint, w binary")
    near = near.groupBy("key", "place", "size", "h", "w").agg(F.count(F.lit(1)).alias("n"))
    hits = near.join(windows, ["size", "h", "w"])
    return checkpoint(hits.groupBy("key").agg(F.max("n").alias("n_rows"), F.collect_set(F.struct("place", "size")).alias("places"), F.collect_set("i").alias("names")))


def score(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, spans: bool = False, keep: list[str] | None = None, block_words: int | None = None) -> DataFrame:
    """A row per document: the columns keep (whose names may clash with the others'), then n_words, n_hit, n_items, items_sha256, contaminated and, if
    wanted, spans: array of (start, end) in bytes of the text's UTF-8, of runs of hit words."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    plain = docs.select(F.col(_q(text_col)).alias("t"), *(F.col(_q(c)).alias(f"k{i}") for i, c in enumerate(keep)))
    items = _items(benchmark, item_col, item_text_col)
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shared = key = None
    if size <= 10 * (BLOCK_WORDS if block_words is None else block_words):
        shared, key = docs.sparkSession.sparkContext.broadcast([(i, bytes(t)) for i, t in items.collect()]), uuid.uuid4().hex
    else:
        found = _hits_by_text(plain, items, "t", n)
        plain = join_repeated(plain.withColumn("key", F.unhex(F.md5(F.col("t").cast("binary")))), found, "key", "n_rows").drop("key")

    def hits(batch: pa.RecordBatch, w: Words, a: int, b: int):
        """(place of the first word, length, items) of each verified hit in rows a to b."""
        if shared is not None:
            cache = worker_cache()
            if cache.get("window key") != key:
                cache["window set"], cache["window key"] = WindowSet(shared.value, n), key
            yield from cache["window set"].hits(w)
            return
        first = np.searchsorted(w.row, np.arange(b - a))
        places, names = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for r in range(a, b):
            if places[r].is_valid:
                for h in places[r].as_py():
                    yield int(first[r - a]) + h["place"], h["size"], names[r].as_py()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(batch.column(0))
        rows = batch.num_rows
        n_words, n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        items: dict[int, set[str]] = {}
        runs: list[list[tuple[int, int]]] = [[] for _ in range(rows if spans else 0)]
        for a, b in groups(off):
            w = Words(data, off[a : b + 1])
            n_words[a:b] += np.bincount(w.row, minlength=b - a)
            change = np.zeros(len(w.hash) + 1, np.int64)
            found = False
            for i, size, names in hits(batch, w, a, b):
                found = True
                change[i] += 1
                change[i + size] -= 1
                items.setdefault(a + int(w.row[i]), set()).update(names)
            if found:
                hit = np.cumsum(change[:-1]) > 0
                n_hit[a:b] += np.bincount(w.row[hit], minlength=b - a)
                if spans:
                    at = np.flatnonzero(hit)
                    new = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(w.row[at], prepend=-1) != 0))
                    for x, y in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist()):
                        r = a + int(w.row[x])
                        runs[r].append((int(w.start[x] - off[r]), int(w.end[y] - off[r])))
        digest = [hashlib.sha256(",".join(sorted(items.get(r, ()))).encode()).hexdigest() for r in range(rows)]
        out = {f"k{i}": batch.column(1 + i) for i in range(len(keep))}
        out |= {"n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "n_items": pa.array([len(items.get(r, ())) for r in range(rows)], pa.int64()), "items_sha256": pa.array(digest), "contaminated": pa.array(n_hit > 0)}
        if spans:
            out["spans"] = pa.array([[{"start": x, "end": y} for x, y in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_pydict(out)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", *["spans array<struct<start:bigint,end:bigint>>"] * spans])
    out = map_batches(plain, run, schema)
    return out.toDF(*keep, *out.columns[len(keep) :])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the byte ranges spans, which are in order."""
    raw = text.cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    parts = F.zip_with(ends, starts, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    return F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10, action: str = "drop") -> DataFrame:
    """docs with the same columns: action "drop" leaves out contaminated documents, "cut" removes the hit words'
    spans from their texts instead."""
    if action not in ("drop", "cut"):
        raise ValueError(f"action {action!r} is neither drop nor cut")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_col)}"
    copy = plain.withColumn("kept", F.col(text))
    out = score(copy, benchmark, text, n=n, spans=action == "cut", keep=["kept" if c == text else c for c in plain.columns])
    if action == "drop":
        out = out.filter(~F.col("contaminated"))
    else:
        out = out.withColumn("kept", without_spans(F.col("kept"), F.col("spans")))
    return out.select(*(F.col("kept" if c == text else c).alias(x) for c, x in zip(plain.columns, names)))
