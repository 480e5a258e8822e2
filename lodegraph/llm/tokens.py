"""Token counts and byte-level BPE encoding and decoding of whole tables.

Null texts count as empty: no tokens, no bytes. Every row gives one row, repeated or not; empty tables give empty
results; columns of the input other than those named do not matter. Both are single passes without a shuffle:
texts are cut into pieces, and a worker solves each distinct piece once by prefix dynamic programming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TextCodec
from .common import groups, map_batches, utf8, worker_cache


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = TextCodec.of(path)
        data, off = utf8(b.column(1))
        n = np.concatenate([codec.encode_rows(data, off[x : y + 1])[0] for x, y in groups(off)])
        return pa.RecordBatch.from_pydict({"i": b.column(0), "n_bytes": pa.array(np.diff(off)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, f"i {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("i", id_col)


def truncate(docs: DataFrame, path: str, limit: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, text (the longest beginning of at most limit tokens, in whole characters), n_bytes and n_tokens of it, and
    cut (whether that is not all) of each row; null texts count as empty. Read off the table of prefixes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = TextCodec.of(path)
        text, size, n, cut = [], [], [], []
        for x in b.column(1).to_pylist():
            raw = (x or "").encode()
            i, k = codec.fits(x or "", limit)
            text.append(raw[:i].decode())
            size.append(i)
            n.append(k)
            cut.append(i < len(raw))
        return pa.RecordBatch.from_pydict({"i": b.column(0), "text": pa.array(text, pa.string()), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "cut": pa.array(cut, pa.bool_())})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return map_batches(rows, run, f"i {kind}, text string, n_bytes bigint, n_tokens bigint, cut boolean").withColumnRenamed("i", id_col)


def reencode(edits: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", start_col: str = "start", end_col: str = "end", new_col: str = "new", id_col: str = "doc_id") -> DataFrame:
    """id, text, ids and n_reused of rows that replace characters start to end of a text, of which the ids are known;
    only pieces near the edit are encoded again. Null texts, ids and replacements count as empty, null places as 0 and
    the start; places beyond the text as its end. Appending is an edit at the end."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = TextCodec.of(path)
        text, ids, used = [], [], []
        for t, x, a, z, new in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
            t, a = t or "", a or 0
            out = codec.edited(t, x or codec.ids(t), a, a if z is None else z, new or "")
            for some, y in zip((text, ids, used), out):
                some.append(y)
        return pa.RecordBatch.from_pydict({"i": b.column(0), "text": pa.array(text, pa.string()), "ids": pa.array(ids, pa.list_(pa.int32())), "n_reused": pa.array(used, pa.int64())})

    kind = edits.schema[id_col].dataType.simpleString()
    rows = edits.select(*(F.col(c).alias(n) for c, n in zip((id_col, text_col, ids_col, start_col, end_col, new_col), "itxazn")))
    return map_batches(rows, run, f"i {kind}, text string, ids array<int>, n_reused bigint").withColumnRenamed("i", id_col)


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in order of id, and where each begins."""
    cache = worker_cache()
    if ("token bytes", path) not in cache:
        known = TextCodec.of(path).bpe.bytes
        parts = [known.get(i, b"") for i in range(max(known, default=-1) + 1)]
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        cache[("token bytes", path)] = np.frombuffer(b"".join(parts), np.uint8), at
    return cache[("token bytes", path)]


def decode_all(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids, their tokens' bytes in a row, and where each token's begin, with the end last."""
    data, at = _token_bytes(path)
    start, size = at[ids], at[ids.astype(np.int64) + 1] - at[ids]
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    places = np.arange(int(ends[-1]))
    places += np.repeat(start - ends[:-1], size)
    return ids, data[places], ends


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    return decode_all(ids, path)[1].tobytes()


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row and, if wanted, ids: array of int.

    The digest of the ids is over little-endian unsigned 32-bit integers; decoding starts from those ids."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = TextCodec.of(path)
        data, off = utf8(b.column(1))
        for x, y in groups(off):
            count, flat = codec.encode_rows(data, off[x : y + 1])
            all_ids = flat()
            _, text, ends = decode_all(all_ids, path)
            ids, decoded, at = [], [], 0
            for c in count.tolist():
                ids.append(hashlib.sha256(all_ids[at : at + c].astype("<u4", copy=False)).hexdigest())
                decoded.append(hashlib.sha256(text[ends[at] : ends[at + c]]).hexdigest())
                at += c
            out = {"i": b.column(0).slice(x, y - x), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(all_ids))
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"i {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = map_batches(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, schema)
    return out.withColumnRenamed("i", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id and text of rows of token ids; null ids give an empty text, bytes that aren't UTF-8 replacement characters."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [decode_ids(np.array(x.as_py() or [], np.int64), path).decode("utf-8", "replace") for x in b.column(1)]
        return pa.RecordBatch.from_pydict({"i": b.column(0), "text": pa.array(text, pa.string())})

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(F.col(id_col).alias("i"), F.col(ids_col).alias("x")), run, f"i {kind}, text string").withColumnRenamed("i", id_col)
