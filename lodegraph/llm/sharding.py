"""Sharding by weighted rendezvous hashing of stable record keys. DataFrame operations only.

A record's shard is the one with the least -ln(u)/weight, where u in (0, 1) comes from the MD5 digest of key and
shard number; ties go to the smaller shard. Key and shard count (and weights) alone decide, so one more shard takes
records only into itself, about its share of each.

A null key counts as the empty string, a null text as empty; rows that repeat a key go to the same shard; empty
tables give empty results; other columns do not matter, and write keeps them, also one named shard. Slots number the rows of a shard from 0 without gaps, in the order of a digest of key,
checksum and size; equal rows take slots next to each other.

Scale: scores are computed row by row. For slots, equal rows are first counted together (partial aggregation), then
ranked inside buckets by the first digits of the digest, and buckets are offset by running totals of at most
16**DIGITS rows a shard. No window spans a shard, and texts are never shuffled. Slots of over CHUNK equal rows are
given in parts, spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that name a bucket of a shard: 4096 buckets each.
DIGITS = 3
CHUNK = 100_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a string key among len(weights) shards; shards of weight 0 take nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    scores = []
    for shard, w in enumerate(weights):
        if w > 0:
            # 52 bits, moved by a half so that u is neither 0 nor 1.
            u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
            scores.append(F.struct((-F.log(u) / float(w)).alias("score"), F.lit(shard).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign(docs: DataFrame, shards: int = 8, weights: list[float] | None = None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: key, size (UTF-8 bytes and 1), text_crc32, law, shard, slot, grown_shard (with one more
    shard of the mean weight)."""
    weights = [1.0] * shards if weights is None else [float(w) for w in weights]
    grown = [*weights, sum(weights) / len(weights)]
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(key_col).alias("k"), key.alias("s"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    same = rows.groupBy("k", "s", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    same = same.select("*", rendezvous(F.col("s"), weights).alias("shard"), F.md5(F.concat_ws("/", "s", F.col("crc").cast("string"), F.col("size").cast("string")).cast("binary")).alias("digest"))
    # The last shard of the grown set takes a record only if it scores better than the record's own.
    same = same.withColumn("grown", rendezvous(F.col("s"), grown))
    same = same.withColumn("bucket", F.substring("digest", 1, DIGITS))
    inside = Window.partitionBy("shard", "bucket").orderBy("digest", "k").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sizes = same.groupBy("shard", "bucket").agg(F.sum("n").alias("m"))
    above = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("offset"))
    out = ranked.join(offsets, ["shard", "bucket"])
    first = F.col("offset") + F.col("before")
    out = out.select("k", "size", "crc", "shard", "grown", "n", first.alias("first"))
    few = out.filter(F.col("n") <= CHUNK)
    many = out.filter(F.col("n") > CHUNK).withColumn("from", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    many = many.withColumn("n", F.least(F.lit(CHUNK).cast("long"), F.col("first") + F.col("n") - F.col("from"))).withColumn("first", F.col("from")).drop("from").repartition("shard", "first")
    out = few.unionByName(many).withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return out.select(F.col("k").alias(key_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown").cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = 8, weights: list[float] | None = None, key_col: str = "doc_id") -> None:
    """Writes the documents under path/shard=N, with all their columns; shard_number=N, if one is named shard."""
    weights = [1.0] * shards if weights is None else [float(w) for w in weights]
    name = next(n for n in ("shard", "shard_number", *(f"shard_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    docs.withColumn(name, rendezvous(F.coalesce(F.col(key_col).cast("string"), F.lit("")), weights)).write.mode("overwrite").partitionBy(name).parquet(path)
