"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted from the whole text's bytes and words, vectorised; identifiers, languages, sources and labels
are never inputs. Trees are grown on histograms of binned statistics from a sample of labelled documents of at most
SAMPLE rows, the ones with the least hash of their id, and flattened into arrays, which score whole batches by numpy
indexing.

Null and empty texts have all statistics 0 and get the score that these lead to. Labels that are null, or not 0 or 1,
are left out; a document with several labels counts once for each. Repeated rows get a result each; null ids are not
held out (their remainder is null) and never learnt from. Without any labelled row every score is 0.5. An empty
table gives an empty result.

Scale: one pass for the labelled sample (a broadcast of at most SAMPLE ids), one for scoring; no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpoint, groups, map_batches, utf8

#: The most labelled rows that are learnt from.
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3

_CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "pipe", "brackets", "marks", "symbols", "other", "high"]
NAMES = ["bytes", "words", *(f"share_{c}" for c in _CLASSES), "word_length", "distinct_words", "repeated_next", "distinct_pairs", "lines", "distinct_lines", "words_a_line", "longest_run", "top_word", "ends_open", "short_words", "long_words"]


def _classes() -> np.ndarray:
    kinds = np.full(256, _CLASSES.index("other"), np.uint8)
    for name, some in {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\r\n", "stop": b".,;:", "pipe": b"|", "brackets": b"()[]{}<>", "marks": b"!?", "symbols": b"#$%&*@^~=+_/\\"}.items():
        kinds[list(some)] = _CLASSES.index(name)
    kinds[0x80:] = _CLASSES.index("high")
    return kinds


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often the most frequent one occurs."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    which = (key[new] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, which, np.diff(np.append(new, len(key))))
    return np.bincount(which, minlength=rows), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A line of numbers, as NAMES has them, for each row of UTF-8 bytes."""
    rows = len(off) - 1
    size = np.diff(off)
    part = data[off[0] : off[-1]]
    of = np.repeat(np.arange(rows), size)
    kinds = _classes()[part]
    count = np.bincount(of * 16 + kinds, minlength=rows * 16).reshape(rows, 16)[:, : len(_CLASSES)]
    w = Words(data, off)
    words = np.bincount(w.row, minlength=rows)
    n, b = np.maximum(words, 1), np.maximum(size, 1)
    length = np.minimum(w.end - w.start, 1000)
    distinct, most = _distinct(w.row, w.hash, rows)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    at = np.arange(len(again))
    run = at - np.maximum.accumulate(np.where(again, 0, at))
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, w.row, run)
    i, pair = w.ngrams(2)
    pairs, _ = _distinct(w.row[i], pair, rows)
    # Lines by the sum of their words' hashes with place weights, so that equal lines are equal.
    breaks = np.flatnonzero(part == 10) + off[0]
    line = np.searchsorted(breaks, w.start) + w.row
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1]))) if len(line) else np.zeros(0, int)
    line_hash = np.add.reduceat(w.hash * (np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line)))) + 1).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
    lines = np.bincount(w.row[first], minlength=rows)
    distinct_lines, _ = _distinct(w.row[first], line_hash * np.uint64(0x9E3779B97F4A7C15), rows)
    last = np.zeros(rows, np.uint8)
    full = np.flatnonzero(size)
    last[full] = data[off[1:][full] - 1]
    stats = [np.log1p(size), np.log1p(words), *(count / b[:, None]).T, np.bincount(w.row, length, rows) / n, distinct / n, np.bincount(w.row, again, rows) / n, pairs / n, lines, distinct_lines / np.maximum(lines, 1), words / np.maximum(lines, 1), longest, most / n, (last != ord(".")) & (size > 0), np.bincount(w.row, length <= 3, rows) / n, np.bincount(w.row, length >= 12, rows) / n]
    return np.stack([np.asarray(s, np.float64) for s in stats], 1)


@dataclass
class Trees:
    """A forest in arrays: node i of tree t tests feature[t, i] > threshold[t, i] and goes to 2i+1 or 2i+2; leaves
    are the nodes of the last level. base is the log-odds that leaf values add to."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    levels: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node - (2**self.levels - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, levels: int = 4, bins: int = 64, rate: float = 0.15, least_rows: int = 5, smooth: float = 1.0) -> Trees:
    """Boosts trees of second-order gains on histograms of at most bins values of each statistic."""
    n, f = x.shape
    p = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**levels - 1, 2**levels
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), levels)
    if not n or y.min() == y.max():
        return Trees(base, out.feature[:0], out.threshold[:0], out.value[:0], levels)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    b = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], 1)
    total = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(levels):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j in range(f):
                key = (node - first) * (bins + 1) + b[:, j]
                gs, hs, cs = (np.bincount(key, v, width * (bins + 1)).reshape(width, -1).cumsum(1) for v in (g, h, np.ones(n)))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                gain[(cs < least_rows) | (ct - cs < least_rows)] = -1
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(width), k] > best)
                best[better] = gain[better, k[better]]
                out.feature[t, first + better], out.threshold[t, first + better] = j, edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        out.value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        total += out.value[t, leaf]
    return out


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _statistics_of(docs: DataFrame, text_col: str, first: Column, kind: str) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(b.column(1))
        x = np.concatenate([statistics(data, off[a : c + 1]) for a, c in groups(off)])
        at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        return pa.RecordBatch.from_pydict({"k": b.column(0), "x": pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))})

    return map_batches(docs.select(first.alias("k"), F.col(text_col).alias("t")), run, f"k {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from labelled documents outside the held-out fold."""
    good = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("i")) != 0))
    some = checkpoint(good.orderBy(F.xxhash64("i"), "i", "y").limit(sample))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(some), "i")
    each = _statistics_of(rows, "t", F.struct("i", "y"), f"struct<i:{docs.schema[id_col].dataType.simpleString()},y:int>").groupBy("k").agg(F.min("x").alias("x"))
    got = each.select("k.i", "k.y", "x").toPandas().sort_values(["i", "y"])
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    return train(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep and score, of every row."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score" and (keep is not None or c != text_col)]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(b.column(0))
        s = np.concatenate([model.score(statistics(data, off[a : c + 1])) for a, c in groups(off)])
        return pa.RecordBatch.from_pydict({**{f"k{i}": b.column(1 + i) for i in range(len(keep))}, "s": pa.array(s)})

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = map_batches(docs.select(q(text_col).alias("t"), *(q(c).alias(f"k{i}") for i, c in enumerate(keep))), run, ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "s double"]))
    return out.toDF(*keep, "score")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the same columns, without those whose score is below the threshold."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_col)}"
    out = score(plain.withColumn("kept", F.col(text)), model, text, ["kept" if c == text else c for c in plain.columns]).filter(F.col("score") >= threshold)
    return out.select(*(F.col("kept" if c == text else c).alias(x) for c, x in zip(plain.columns, names)))
