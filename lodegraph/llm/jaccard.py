"""N-gram Jaccard join of near-duplicate texts: a MinHash LSH forest, then exact verification.

Words are as in common.Words; a text's n-grams are those of n consecutive words, or all its words if fewer. Two
texts are linked if the Jaccard similarity of their n-gram sets is at least the threshold.

The forest has TREES sorted prefix tries of MinHash signatures. It is first read at prefixes of MAX_DEPTH hashes: texts
below one node get the label of its least text. A prefix is then shortened, to the depth at which a pair at the
threshold meets in some tree with the target recall, only where that adds something: nodes whose texts all have one
label already stay as they are, since texts joined by labels are compared in full anyway. Below a shortened prefix,
texts of different labels are joined if their signatures agree enough for the threshold, less MARGIN. What is joined,
directly or through others, is a candidate group; in it all pairs of agreeing signatures are verified exactly, also
those that no tree has brought together.

Result: a row per document: doc_id, text_class (least doc_id with an equal text), class_id (least doc_id reached by
links and equal texts), n_links (other texts linked to this one; copies of one text count once), n_copies.
Texts without words, null ones included, link to nothing and share a class only by equal text if they have bytes;
null and empty texts stay alone. Rows with a null doc_id get null classes and no links. Rows that repeat a doc_id
and its text count as one document each, with equal results; one doc_id with several texts is several texts, each
row with the class of its own. An empty table gives an empty result; other columns do not matter.

Scale: equal texts are collapsed first by a hash with partial aggregation. What is shuffled for every text is a node
number a tree; signatures only for texts of shortened nodes with several labels, and n-grams once for each text that
has a candidate. Nodes and groups of more than BLOCK texts, or BLOCK_BYTES of n-grams, are split into pairs of blocks,
each a group of its own, so no task holds a whole hot one, and none is capped. Groups emit links as member rows with
counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, Words, broadcast_if_small, checkpoint, claim, groups, map_batches, mix, utf8

TREES, MAX_DEPTH, RECALL, MARGIN, BLOCK, BLOCK_BYTES = 36, 6, 0.99, 0.2, 4096, 16_000_000
#: Texts with candidates of which numbers are broadcast, about 80 bytes each; beyond, they are joined by a shuffle.
WANTED = 3_000_000
_SEED = 4711


def depth(threshold: float, trees: int = TREES, recall: float = RECALL, deepest: int = MAX_DEPTH) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with the target recall."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _grams(w: Words, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all n-grams, in order of row; a row of fewer words has one n-gram of all."""
    i, h = w.ngrams(n)
    row = w.row[i]
    count = np.bincount(w.row, minlength=rows)
    extra_row, extra = [], []
    for size in range(1, n):
        i, x = w.ngrams(size)
        keep = count[w.row[i]] == size
        extra_row.append(w.row[i][keep])
        extra.append(x[keep])
    row, h = np.concatenate([row, *extra_row]), np.concatenate([h, *extra])
    if sum(map(len, extra)):
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def _signatures(row: np.ndarray, h: np.ndarray, rows: int, hashes: int) -> np.ndarray:
    """MinHash signatures, a line of 32-bit numbers per row; the rows have at least one n-gram each."""
    out = np.zeros((rows, hashes), np.uint32)
    have = np.unique(row)
    a = np.random.default_rng(_SEED).integers(0, 1 << 31, (2, hashes), np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    start = np.searchsorted(row, have)
    # In slices of whole rows that stay in the processor's cache.
    cut = 0
    while cut < len(have):
        to = max(cut + 1, int(np.searchsorted(start, start[cut] + 50_000)))
        lo, hi = start[cut], start[to] if to < len(have) else len(x)
        part, at = x[lo:hi], start[cut:to] - lo
        for k in range(hashes):
            out[have[cut:to], k] = np.minimum.reduceat(part * (a[0, k] * np.uint32(2) + np.uint32(1)) + a[1, k], at)
        cut = to
    return out


def _thumbs(s: np.ndarray) -> np.ndarray:
    """A byte of each hash. Minima of long texts are small numbers: their bits are mixed before one byte is taken."""
    return ((s * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, text_col: str, id_col: str, n: int, trees: int, d: int) -> DataFrame:
    """id, h (digest of the text), size (n-grams), nodes (64-bit hash of each tree's prefix of d hashes; empty without
    words) and sig (a byte of each hash) of each row with an id and a text that isn't empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(b.column(2))
        nodes, sig, size = [], [], []
        for x, y in groups(off):
            row, h = _grams(Words(data, off[x : y + 1]), y - x, n)
            s = _signatures(row, h, y - x, trees * d)
            tree = np.tile(np.arange(1, trees + 1, dtype=np.uint64), (y - x, 1))
            for k in range(d):
                tree = mix((tree << np.uint64(1)) + s[:, k::d] + np.uint64(k + 1))
            nodes.append(tree.view(np.int64))
            sig.extend(bytes(z) for z in _thumbs(s))
            size.append(np.bincount(row, minlength=y - x))
        size = np.concatenate(size)
        flat = np.concatenate(nodes)[size > 0].ravel()
        at = np.zeros(len(size) + 1, np.int32)
        np.cumsum(np.where(size > 0, trees, 0), out=at[1:])
        return pa.RecordBatch.from_pydict({"id": b.column(0), "h": b.column(1), "size": pa.array(size, pa.int64()), "nodes": pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), "sig": pa.array(sig, pa.binary())})

    t = F.col(text_col)
    rows = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(t) > 0)).select(F.col(id_col).cast("long").alias("id"), _digest(t).alias("h"), t.alias("t"))
    return map_batches(rows, run, "id bigint, h binary, size bigint, nodes array<bigint>, sig binary")


def _runs(keys: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys in n rows."""
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    s = np.flatnonzero(new)
    return s, np.append(s[1:], n)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows that are sorted by the key column; a table has many small groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """rows with blocks (null for one) become rows with own, lo, hi: a copy for each pair of blocks with its own."""
    own = F.coalesce(F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"), F.lit(0))
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return out.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks").repartition(key, "lo", "hi")


def deep_nodes(nodes: Column, depth: int, d: int) -> Column:
    """Nodes of longer prefixes: a tree's own hashes, and those of the trees after it."""
    parts, n = [nodes], F.size(nodes)
    for k in range(1, depth // d):
        parts.append(F.concat(F.slice(nodes, F.least(F.lit(k + 1), n + 1), F.greatest(n - k, F.lit(0))), F.slice(nodes, 1, F.least(F.lit(k), n))))
    return F.transform(F.arrays_zip(*(p.alias(f"n{i}") for i, p in enumerate(parts))), lambda x: F.xxhash64(x))


def candidates(texts: DataFrame, trees: int, d: int, deepest: int, threshold: float) -> DataFrame:
    """a, b: numbers of texts, edges that join all texts which may be linked, as a checkpoint. texts: t, nodes, sig."""
    hashes, need = trees * d, max(0.0, threshold - MARGIN - 1 / 256) * trees * d
    # Long prefixes first: a node's least text is the label of those below it.
    long = texts.select("t", F.explode(deep_nodes(F.col("nodes"), deepest, d)).alias("k"))
    leaders = checkpoint(long.groupBy("k").agg(F.min("t").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", "leader"))
    deep = checkpoint(long.join(broadcast_if_small(leaders), "k").filter("t != leader").select("t", "leader").distinct())
    labels = checkpoint(deep.groupBy("t").agg(F.min("leader").alias("label")))
    # Then shorter ones, of the nodes that hold several labels.
    labelled = texts.select("t", "nodes").join(broadcast_if_small(labels), "t", "left").select("t", F.coalesce("label", "t").alias("label"), F.explode("nodes").alias("k"))
    several = labelled.groupBy("k").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b")
    several = checkpoint(several.select("k", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK).cast("int")).alias("blocks")))
    met = labelled.join(broadcast_if_small(several), "k").join(texts.select("t", "sig"), "t")
    met = _spread(met.select("k", "blocks", "label", "t", "sig"), "k").select("k", "lo", "hi", "own", "label", "sig")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for t in _whole_groups(batches, 0):
            t = t.combine_chunks()
            k, lo, hi, own, label = (t[c].to_numpy() for c in ("k", "lo", "hi", "own", "label"))
            sig = _plain_bytes(t["sig"], hashes)
            s, e = _runs([k, lo, hi], len(k))
            a, b = [], []
            # Most nodes have two texts: all of these at once.
            two = s[(e - s == 2) & (lo[s] == hi[s])]
            two = two[label[two] != label[two + 1]]
            ok = two[(sig[two] == sig[two + 1]).sum(1) >= need]
            a.append(label[ok])
            b.append(label[ok + 1])
            for x, y in zip(s.tolist(), e.tolist()):
                if y - x > 2 or lo[x] != hi[x]:
                    for i, some in _joined(sig[x:y], label[x:y], own[x:y], lo[x] != hi[x], need):
                        a.append(np.full(len(some), i))
                        b.append(some)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    short = met.sortWithinPartitions("k", "lo", "hi").mapInArrow(across, "a bigint, b bigint")
    both = short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(deep.select(F.col("leader").alias("a"), F.col("t").alias("b")))
    return checkpoint(both.distinct())


def _joined(sig: np.ndarray, label: np.ndarray, own: np.ndarray, two_blocks: bool, need: float) -> Iterator[tuple[int, np.ndarray]]:
    """Labels that are joined in a group of texts: pairs of different labels, of different blocks if there are two,
    whose signatures agree in at least need places. The texts of the commonest label need not be gone through."""
    names, each = np.unique(label, return_inverse=True)
    many = np.bincount(each)
    if len(many) < 2:
        return
    order = np.argsort(each == many.argmax(), kind="stable")
    sig, each, own = sig[order], each[order], own[order]
    for i in range(len(each) - int(many.max())):
        rest = each[i + 1 :]
        ok = rest != each[i]
        if two_blocks:
            ok &= own[i + 1 :] != own[i]
        ok = np.flatnonzero(ok)
        if len(ok):
            ok = ok[(sig[i + 1 :][ok] == sig[i]).sum(1) >= need]
        if len(ok):
            yield int(names[each[i]]), names[np.unique(rest[ok])]


def _verified(sig: np.ndarray, grams: list[np.ndarray], own: np.ndarray, two_blocks: bool, need: float, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of a group, the later ones that are linked to it; of the other block only, if there are two."""
    size = np.array([len(g) for g in grams])
    for i in range(len(grams) - 1):
        rest = np.arange(i + 1, len(grams))
        ok = np.minimum(size[i], size[rest]) >= threshold * np.maximum(size[i], size[rest])
        if two_blocks:
            ok &= own[rest] != own[i]
        rest = rest[ok]
        if len(rest):
            rest = rest[(sig[rest] == sig[i]).sum(1) >= need]
        mine = grams[i]
        for part in np.array_split(rest, max(1, len(rest) * len(mine) * 8 // GROUP_BYTES)):
            if not len(part):
                continue
            theirs = [grams[j] for j in part.tolist()]
            n = size[part]
            each = np.concatenate(theirs)
            at = np.minimum(np.searchsorted(mine, each), len(mine) - 1)
            common = np.add.reduceat(mine[at] == each, np.cumsum(n) - n, dtype=np.int64)
            hit = part[common >= threshold * (len(mine) + n - common)]
            if len(hit):
                yield i, hit


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3, threshold: float = 0.5, trees: int = TREES, recall: float = RECALL, with_digest: bool = False) -> DataFrame:
    """A row per document: id, text_class, class_id, n_links, n_copies; see above. with_digest adds h, the digest of
    the text, null for rows that stay alone."""
    d = depth(threshold, trees, recall)
    hashes = trees * d
    need = max(0.0, threshold - MARGIN - 1 / 256) * hashes

    # "first" may take any copy's signature: those of equal texts are equal.
    texts = signatures(docs, text_col, id_col, n, trees, d).groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("nodes").alias("nodes"), F.first("sig").alias("sig"))
    # Numbers of what is written already, so they stay the same whenever it is read.
    texts = checkpoint(texts).withColumn("t", F.monotonically_increasing_id())
    groups_of = components(candidates(texts.filter("size > 0"), trees, d, max(d, MAX_DEPTH), threshold)).select(F.col("id").alias("t"), F.col("class_id").alias("c"))
    with_text = groups_of.join(texts.select("t", "id", "h", "size"), "t")
    wanted = checkpoint(with_text.select(F.xxhash64("id", "h").alias("__k"), "t", "c", "size"))
    large = wanted.groupBy("c").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.col("size") * 8) / BLOCK_BYTES)).cast("int").alias("blocks")).filter("blocks > 1")

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(b.column(2))
        out: list[bytes] = []
        sig: list[bytes] = []
        for x, y in groups(off):
            row, h = _grams(Words(data, off[x : y + 1]), y - x, n)
            at = np.searchsorted(row, np.arange(y - x + 1))
            out.extend(np.unique(h[i:j]).tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist()))
            sig.extend(bytes(z) for z in _thumbs(_signatures(row, h, y - x, hashes)))
        return pa.RecordBatch.from_pydict({"t": b.column(0), "c": b.column(1), "grams": pa.array(out, pa.binary()), "sig": pa.array(sig, pa.binary())})

    text = F.col(text_col)
    from_text = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text) > 0)).select(F.xxhash64(F.col(id_col).cast("long"), _digest(text)).alias("__k"), text.alias("__text"))
    from_text = from_text.join(broadcast_if_small(wanted.select("__k", "t", "c"), WANTED), "__k").select("t", "c", "__text")
    full = map_batches(from_text, sets, "t bigint, c bigint, grams binary, sig binary").join(broadcast_if_small(checkpoint(large)), "c", "left")
    full = _spread(full, "c").select("c", "lo", "hi", "own", "t", "grams", "sig")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for t in _whole_groups(batches, 0):
            c, lo, hi, own, ids = (t[x].to_numpy() for x in ("c", "lo", "hi", "own", "t"))
            # Rows that repeat a document come more than once.
            keep = np.ones(len(c), bool)
            keep[1:] = (ids[1:] != ids[:-1]) | (c[1:] != c[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            t = t.filter(pa.array(keep)).combine_chunks()
            c, lo, hi, own, ids = (x[keep] for x in (c, lo, hi, own, ids))
            sig = _plain_bytes(t["sig"], hashes)
            data, off = utf8(t["grams"].combine_chunks() if isinstance(t["grams"], pa.ChunkedArray) else t["grams"])
            links, root = np.zeros(len(c), np.int64), np.arange(len(c))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = int(root[i])
                return i

            for a, b in zip(*(x.tolist() for x in _runs([c, lo, hi], len(c)))):
                grams = [data[i:j].view(np.uint64) for i, j in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist())]
                for i, hit in _verified(sig[a:b], grams, own[a:b], bool(lo[a] != hi[a]), need, threshold):
                    links[a + i] += len(hit)
                    links[a + hit] += 1
                    for j in hit.tolist():
                        x, y = find(a + i), find(a + j)
                        if x != y:
                            root[max(x, y)] = min(x, y)
            on = np.flatnonzero(links)
            if len(on):
                top = np.array([find(int(i)) for i in on])
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[on]), "root": pa.array(ids[top]), "n": pa.array(links[on])})

    linked = checkpoint(full.sortWithinPartitions("c", "lo", "hi", "t").mapInArrow(verify, "id bigint, root bigint, n bigint"))
    counts = linked.groupBy(F.col("id").alias("t")).agg(F.sum("n").alias("n_links"))
    classes = components(linked.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("t"), F.col("class_id").alias("c"))
    named = classes.join(texts.select("t", "id"), "t")
    named = named.join(named.groupBy("c").agg(F.min("id").alias("class_id")), "c").select("t", "class_id")

    per_text = texts.select("t", "h", F.col("id").alias("text_class"), "n_copies").join(named, "t", "left").join(counts, "t", "left")
    per_text = per_text.select("h", "text_class", F.coalesce("class_id", "text_class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    # A text with many copies is joined in salted parts.
    salts = 16
    hot_texts = checkpoint(texts.filter("n_copies > 1000").select("h", F.lit(True).alias("hot")))
    hot_texts = broadcast_if_small(hot_texts)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(-1)
    i = F.col(id_col).cast("long")
    copies = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text) > 0)).select(i.alias("id"), _digest(text).alias("h"))
    copies = copies.join(hot_texts, "h", "left").withColumn("salt", salt).drop("hot")
    all_salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))
    both = per_text.join(hot_texts, "h", "left").withColumn("salt", F.explode(all_salts)).drop("hot")
    out = copies.join(both, ["h", "salt"]).select(F.col("id").alias(id_col), "text_class", "class_id", "n_links", "n_copies", *["h"] * with_digest)
    alone = docs.filter(F.col(id_col).isNull() | (F.coalesce(F.octet_length(text_col), F.lit(0)) == 0))
    none = [F.lit(None).cast("binary").alias("h")] * with_digest
    return out.unionByName(alone.select(i.alias(id_col), i.alias("text_class"), i.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), *none))


def _plain_bytes(column, width: int) -> np.ndarray:
    data, off = utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return data[off[0] : off[-1]].reshape(-1, width)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and class_id (least id of its component) of all ends of the edges. Each round links every node's
    neighbours to the least of them, large side then small side, until nothing changes; components then are stars."""
    e = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    while True:
        # Large star: neighbours above a node go to the least around it.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and those below it go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        after = checkpoint(small)
        same = after.count() == e.count() and after.join(e, ["u", "v"], "left_anti").isEmpty()
        e = after
        if same:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("class_id")).union(e.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **kinds) -> DataFrame:
    """docs with the same columns: of each class the document with the least id stays, with its repeated rows;
    rows with null ids or empty texts stay as they are."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, key = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    found = join(plain, text, key, with_digest=True, **kinds)
    drop = checkpoint(found.filter(F.col("class_id") != F.col(key)).select(F.xxhash64(F.col(key), "h").alias("k")).distinct())
    mine = F.when(F.octet_length(text) > 0, F.xxhash64(F.col(key).cast("long"), _digest(F.col(text))))
    return plain.withColumn("k", mine).join(broadcast_if_small(drop, WANTED), "k", "left_anti").select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(names)))
