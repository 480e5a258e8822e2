"""The index as tables in a folder: files, units, edges, aliases and vectors.

Tables are cut into buckets by a hash of the path. A manifest names, for each table, the version that holds each
bucket; an update writes new versions of the buckets it touches, then a new manifest, so readers see the old index or
the new one. Ids are hashes of what they name, so they stay where a file changes around them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, snapshot, spans
from .sources import extract

SCHEMAS = {
    "files": "file_id long, path string, language string, kind string, size long, mtime timestamp, sha256 string, indexed_at timestamp, text string",
    "units": "unit_id long, file_id long, file_path string, language string, kind string, unit_type string, name string, qualname string, signature string, summary string, start_line int, start_col int, end_line int, byte_start int, byte_end int, parent_id long",
    "edges": "edge_id long, caller_unit_id long, file_id long, file_path string, callee string, callee_full string, line int, callee_unit_id long",
    "aliases": "file_id long, file_path string, alias string, target string",
    "vectors": "unit_id long, file_path string, language string, kind string, embedding array<float>",
}
_PATH = {"files": "path"}


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Counts of hashed words, of length 1: needs no model and always gives the same."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h & 1 << 31 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


def retrieval_key() -> Column:
    some = [F.coalesce(F.when(F.col("qualname") != "", F.col("qualname")), F.col("name")), F.col("signature"), F.col("summary")]
    return F.concat_ws("\n", *(F.when(c != "", c) for c in some))


def embedding_text(units: DataFrame) -> DataFrame:
    """unit_id and text: the file, language and parent of a unit, then its retrieval key."""
    parents = units.select(F.col("unit_id").alias("parent_id"), F.col("qualname").alias("__parent"))
    lines = [F.concat(F.lit("file: "), "file_path"), F.concat(F.lit("language: "), "language"), F.concat(F.lit("parent: "), "__parent"), retrieval_key()]
    return units.join(parents, "parent_id", "left").select("unit_id", F.concat_ws("\n", *lines).alias("text"))


def valid_vector(v: Column, dimension: int) -> Column:
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def embed(texts: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """unit_id and embedding of rows of unit_id and text; a vector of another size, or not finite, is an error."""
    n = embedder.dimension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                out = embedder.embed(part["text"].tolist())
                if len(out) != len(part) or any(len(v) != n or not all(map(math.isfinite, v)) for v in out):
                    raise ValueError(f"the embedder has to give a finite vector of {n} numbers for each text")
                yield pd.DataFrame({"unit_id": part["unit_id"].to_numpy(), "embedding": out})

    return texts.select("unit_id", "text").mapInPandas(run, "unit_id long, embedding array<float>")


def tables_of(files: DataFrame) -> dict[str, DataFrame]:
    """files, units, edges (unresolved) and aliases of rows of path, language, kind, size, mtime, sha256 and text."""
    found = extract.extract(files).join(files.select("path", "language"), "path").withColumn("file_id", F.xxhash64("path"))
    units = snapshot.stable_ids(found.filter("rec = 'unit'"), ["path", "kind", "unit_type", "qualname"], "byte_start").withColumnRenamed("id", "unit_id")
    units = spans.containment_parent(units, "file_id", "unit_id", "byte_start", "byte_end").withColumn("file_path", F.col("path")).withColumn("start_col", F.lit(0))
    calls = found.filter("rec = 'call'").withColumn("edge_id", F.xxhash64("path", "byte_start", "byte_end", "qualname"))
    inside = units.filter((F.col("kind") == "symbol") & (F.col("unit_type") != "import")).select("file_id", "unit_id", "byte_start", "byte_end")
    callers = spans.smallest_container(calls.select("file_id", "edge_id", "byte_start"), inside.withColumnRenamed("byte_start", "s").withColumnRenamed("byte_end", "e"), "file_id", "byte_start", ["edge_id"], "unit_id", "s", "e")
    edges = calls.join(callers.select("edge_id", F.col("unit_id").alias("caller_unit_id")), "edge_id").dropDuplicates(["edge_id"])
    edges = edges.select("edge_id", "caller_unit_id", "file_id", F.col("path").alias("file_path"), F.col("name").alias("callee"), F.col("qualname").alias("callee_full"), F.col("start_line").alias("line"), F.lit(None).cast("long").alias("callee_unit_id"))
    aliases = found.filter("rec = 'alias'").select("file_id", F.col("path").alias("file_path"), F.col("name").alias("alias"), "target").dropDuplicates(["file_id", "alias"])
    out = {"files": files.withColumn("file_id", F.xxhash64("path")).withColumn("indexed_at", F.lit(datetime.now(UTC))), "units": units, "edges": edges, "aliases": aliases}
    return {n: df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS[n].split(", "))) for n, df in out.items()}


class Index:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # -- storage --

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def manifest(self) -> dict:
        fs, where = self._fs(f"{self.folder}/manifests")
        numbers = [int(x.getPath().getName()[:-5]) for x in fs.listStatus(where) if x.getPath().getName().endswith(".json")] if fs.exists(where) else []
        if not numbers:
            return {"version": 0, "tables": {n: {} for n in SCHEMAS}, "meta": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{max(numbers)}.json").collect()))

    def _publish(self, manifest: dict) -> None:
        fs, part = self._fs(f"{self.folder}/manifests/.{manifest['version']}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, self._fs(f"{self.folder}/manifests/{manifest['version']}.json")[1]):
            raise RuntimeError("another writer has published this version")

    def table(self, name: str, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame:
        some = (manifest or self.manifest())["tables"][name]
        paths = [f"{self.folder}/v{v}/{name}/bucket={b}" for b, v in some.items() if only is None or int(b) in only]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, manifest: dict, new: dict[str, DataFrame], only: list[int] | None = None) -> None:
        """Versions of the tables' buckets, all or only some of them; those without rows are left out."""
        manifest["version"] += 1
        for name, df in new.items():
            path = f"{self.folder}/v{manifest['version']}/{name}"
            df.withColumn("bucket", F.pmod(F.xxhash64(_PATH.get(name, "file_path")), F.lit(self.buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(path)
            fs, where = self._fs(path)
            there = {x.getPath().getName().removeprefix("bucket=") for x in fs.listStatus(where) if x.getPath().getName().startswith("bucket=")}
            kept = {b: v for b, v in manifest["tables"][name].items() if only is not None and int(b) not in only}
            manifest["tables"][name] = kept | dict.fromkeys(there, manifest["version"])
        manifest["meta"]["last_indexed_at"] = datetime.now(UTC).isoformat()
        self._publish(manifest)

    # -- building --

    def index_all(self, files: DataFrame) -> dict[str, int]:
        """Brings the index to the state of the files (as sources.files.scan gives them): only changed ones are read
        again. The numbers of files, changed and deleted ones."""
        have = self.table("files").select("path", "sha256")
        status = snapshot.diff(have, files, "path").cache()
        try:
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
            changed = files.join(status.filter("status IN ('added', 'changed')").select("path"), "path", "left_semi")
            self.replace(changed, status.filter("status = 'deleted'").select("path"))
        finally:
            status.unpersist()
        n = {k: counts.get(k, 0) for k in ("added", "changed", "deleted", "same")}
        return {"files": n["added"] + n["changed"] + n["same"], "changed": n["added"] + n["changed"], "deleted": n["deleted"]}

    def index_paths(self, files: DataFrame, paths: DataFrame) -> None:
        """As index_all, of some paths only: those without a file are deleted."""
        there = files.join(paths.select("path").distinct(), "path", "left_semi")
        self.replace(there, paths.select("path").distinct().join(there.select("path"), "path", "left_anti"))

    def replace(self, files: DataFrame, deleted: DataFrame) -> None:
        """Puts the rows of these files in place of what there is of them, and takes away the deleted ones; then
        resolves all edges again, since names may have come or gone."""
        manifest = self.manifest()
        gone = files.select("path").unionByName(deleted.select("path")).distinct()
        touched = [r[0] for r in gone.select(F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        if not touched:
            return
        new = tables_of(files)
        kept = {n: self.table(n, manifest, touched).join(gone.withColumnRenamed("path", _PATH.get(n, "file_path")), _PATH.get(n, "file_path"), "left_anti") for n in SCHEMAS}
        names = {n: [c.split()[0] for c in SCHEMAS[n].split(", ")] for n in SCHEMAS}
        both = {n: kept[n].select(*names[n]).unionByName(new[n]) if n in new else None for n in SCHEMAS}
        # Vectors stay where their unit's text is the same as before.
        old, now = embedding_text(self.table("units", manifest, touched)), embedding_text(both["units"])
        same = old.join(now, ["unit_id", "text"], "left_semi").select("unit_id")
        both["vectors"] = self.table("vectors", manifest, touched).join(same, "unit_id", "left_semi").select(*names["vectors"])
        self._write(manifest, both, touched)
        self.resolve()

    def delete(self, paths: DataFrame) -> None:
        self.replace(self.table("files").limit(0).select("path", "language", "kind", "size", "mtime", "sha256", "text"), paths)

    def resolve(self) -> None:
        manifest = self.manifest()
        edges = self.table("edges", manifest)
        found = graph.resolve_edges(edges, self.table("units", manifest), self.table("aliases", manifest)).select("edge_id", "callee_unit_id")
        self._write(manifest, {"edges": edges.drop("callee_unit_id").join(found.dropDuplicates(["edge_id"]), "edge_id", "left").select(*(c.split()[0] for c in SCHEMAS["edges"].split(", ")))})

    def embed(self, embedder: Embedder, fingerprint: str = "") -> None:
        """Vectors of units that have none; of all, if the fingerprint (of model and settings) is another one."""
        manifest = self.manifest()
        units, have = self.table("units", manifest), self.table("vectors", manifest)
        if manifest["meta"].get("fingerprint", "") != fingerprint:
            have = have.limit(0)
        missing = snapshot.missing(units, have, "unit_id", "unit_id")
        texts = embedding_text(units).join(missing.select("unit_id"), "unit_id", "left_semi")
        new = units.join(embed(texts, embedder), "unit_id").select("unit_id", "file_path", "language", "kind", "embedding")
        manifest["meta"]["fingerprint"] = fingerprint
        self._write(manifest, {"vectors": have.unionByName(new)})

    def repair(self) -> None:
        """Takes away vectors without a unit, and edges' callees that are no unit any more."""
        manifest = self.manifest()
        ids = self.table("units", manifest).select("unit_id")
        edges, vectors = self.table("edges", manifest), self.table("vectors", manifest)
        known = ids.select(F.col("unit_id").alias("callee_unit_id"), F.lit(True).alias("known"))
        edges = edges.join(known, "callee_unit_id", "left").withColumn("callee_unit_id", F.when(F.col("known"), F.col("callee_unit_id"))).drop("known")
        self._write(manifest, {"edges": edges.select(*(c.split()[0] for c in SCHEMAS["edges"].split(", "))), "vectors": vectors.join(ids, "unit_id", "left_semi").select(*vectors.columns)})

    def stats(self) -> DataFrame:
        """One row: files, units, embedded, by_language (map), last_indexed_at."""
        m = self.manifest()
        by = self.table("files", m).groupBy("language").count().agg(F.map_from_entries(F.collect_list(F.struct("language", "count"))).alias("by_language"), F.coalesce(F.sum("count"), F.lit(0)).alias("files"))
        one = lambda n, c: self.table(n, m).agg(F.count(F.lit(1)).alias(c))
        return by.crossJoin(one("units", "units")).crossJoin(one("vectors", "embedded")).withColumn("last_indexed_at", F.lit(m["meta"].get("last_indexed_at")))  # one row each


def refresher(index: Index, scan: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For streaming.coalesce.refresh: indexes the changed paths of each batch from a fresh scan."""
    return lambda paths, number: index.index_paths(scan(), paths)
