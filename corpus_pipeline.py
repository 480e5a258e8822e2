"""The corpus pipeline: each stage takes documents, and gives what it keeps to the next.

Every stage but the last returns the columns it was given, extra ones and those with clashing names included; names of
two columns have to differ, as for Parquet. Null and empty texts are scored like any other, are no duplicates of each
other, have no benchmark passages and no personal data, and encode to nothing. Rows with a null doc_id are never
dropped as duplicates; rows that repeat a doc_id and its text share their fate, and one doc_id with several texts is
judged text by text. An empty table goes through all stages; without labels the classifier keeps everything, since its
score is 0.5.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import common, decontaminate, jaccard, pii, quality, queries, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier rejects."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal or similar texts."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents with passages of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts."""
    return pii.sanitise(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes texts; gives doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    return tokens.encode(docs, queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each keeps is written to the shared folder and read again. A stage's
    input is removed once its output is written."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
