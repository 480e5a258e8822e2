"""Snapshots of a collection: differences, staleness, stable ids and referential checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, sha: str = "sha256") -> DataFrame:
    """key and status: added, deleted, changed or same."""
    a, b = old.select(F.col(key), F.col(sha).alias("__a"), F.lit(1).alias("__ia")), new.select(F.col(key), F.col(sha).alias("__b"), F.lit(1).alias("__ib"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("__ia").isNull(), "added").when(F.col("__ib").isNull(), "deleted").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return both.select(key, status.alias("status"))


def stale(indexed: DataFrame, current: DataFrame, key: str, sha: str = "sha256") -> DataFrame:
    """key and stale of indexed rows: true if the current row is missing or differs."""
    now = current.select(F.col(key), F.col(sha).alias("__now"))
    return indexed.join(now, key, "left").select(key, (F.col("__now").isNull() | (F.col("__now") != F.col(sha))).alias("stale"))


def stable_ids(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """rows with ordinal (from 1, by seq within equal keys) and id, a hash of keys and ordinal: rows keep their id
    as long as as many equal ones come before them."""
    out = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(seq)))
    return out.withColumn("id", F.xxhash64(*keys, "ordinal"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def missing(rows: DataFrame, have: DataFrame, key: str, have_key: str) -> DataFrame:
    return rows.join(have.select(F.col(have_key).alias(key)), key, "left_anti")
