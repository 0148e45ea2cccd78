"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of docs.
Rows without a doc_id go through all stages, but are linked with no near copy. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import common, exact_dedup, near_dedup, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by itself."""
    return quality.judged(docs, quality.trusted_ids(spark, sf_dir)).where("kept").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; of rows equal in doc_id and text any one. A null doc_id is less than all others.
    Rows that have a doc_id in common but not the text are told apart."""
    state = exact_dedup.DedupState(spark, common.work_dir(spark), goes_on=False)
    several = exact_dedup.classes(docs, state).where("group_size > 1").groupBy("doc_id", "digest", "keep_id").agg(F.count("*").alias("n"))
    marks = several.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.expr("not (doc_id <=> keep_id)").alias("__copy"), "n")
    marks = common.stored(marks.where("__copy or n > 1").drop("n"), common.work_dir(spark))
    common.remove(spark, state.folder)
    marks = F.broadcast(marks) if marks.count() * 100 <= common.BROADCAST_BYTES else marks.hint("shuffle_hash")
    text = F.coalesce(docs["text"], F.lit(""))
    met = docs["doc_id"].eqNullSafe(marks["__id"]) & (F.sha2(text, 256) == marks["__digest"])
    repeated = docs.join(marks.where("not __copy"), met, "left_semi")
    return docs.join(marks, met, "left_anti").unionByName(repeated.withColumn("__text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "__text"]).drop("__text"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id."""
    work = common.work_dir(spark)
    dropped = common.stored(near_dedup.near_classes(docs, work=work).where("doc_id != component_id").select("doc_id"), common.work_dir(spark))
    common.remove(spark, work)
    return common.matching(docs, dropped, "doc_id", False)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; where the scan found secrets, a mark stands in their place and n_chars is counted anew."""
    return secrets.redacted(docs, secrets.Ledger(spark, f"{common.work_dir(spark)}/ledger"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: BPE, sketches and planned slots are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Steps of a stage, and what the stage before kept, are removed as soon as its own result is stored."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{common.work_dir(spark)}/{name}"
        with common.scope(spark):
            docs = common.stored(stage(spark, docs, sf_dir), path)
        if last:
            common.remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir).select(*(F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")))
