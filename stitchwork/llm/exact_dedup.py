"""op6: exact deduplication as a stateful stream.

A batch of documents is read once for its keys: digest (SHA-256 of the text), identifier and locator, the batch in whose content the
text lies. The keys run as a stream through an aggregation by digest whose state is kept on disk by RocksDB and checkpointed to the shared
folder, without a watermark, so that no digest ever expires; more batches added to the same state, in this session or a later one, meet all
earlier ones, and each gives out only the digests that it has itself. State per digest: how many rows, identifier and locator of the one
that stays (the largest identifier), and the first locator. Rows are summed up before the shuffle, so that a digest of very many rows
costs each task one row.

A digest alone does not make texts equal. Rows whose digest occurs more than once (hits) are grouped by digest and whole text, together
with the texts of earlier batches, read from the batches between the locators of hits: the row that stays and the group's size are those
of all batches so far.

A null text counts as empty; equal texts are identical ones, without any change before. An empty table gives no rows. Nothing is joined
by identifiers: a null one is less than all others, and stays only where all of a group are null; repeated rows each come out, and each
counts in the group's size. Columns other than identifier and text are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stitchwork.llm import common

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Settings of the state's store. Without fallocate an empty store takes a few kB of disk, and not 4 MB for each partition;
#: small write buffers do the same for memory, which stores keep for a while after their query.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class DedupState:
    """Keyed state of all documents so far, below a folder that driver and executors share. Where it goes on with later batches, it keeps
    the texts of each batch, one row for equal ones, as the files of its input may change."""

    def __init__(self, spark: SparkSession, folder: str, goes_on: bool = True):
        self.spark, self.folder, self.goes_on = spark, folder, goes_on
        self.batches = len(common.names_in(spark, f"{folder}/keys"))

    def add(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The batch's digest and doc_id, as stored, and digest, n, doc_id (that stays), first (locator), over all batches so far, of each
        digest of the batch, after these rows of digest, doc_id."""
        self.batches += 1
        keys = common.stored(keys.withColumn("locator", F.lit(self.batches)), f"{self.folder}/keys/{self.batches}")
        stream = self.spark.readStream.schema(keys.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/keys")
        state = stream.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("kept"), F.min("locator").alias("first"))
        out = f"{self.folder}/state-{self.batches}"
        old = {k: self.spark.conf.get(k, None) for k in ROCKSDB}
        for k, v in ROCKSDB.items():
            self.spark.conf.set(k, v)
        try:
            query: StreamingQuery = (
                state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True)
                .foreachBatch(lambda rows, _: rows.select("digest", "n", "kept.doc_id", "first").write.mode("overwrite").parquet(out)).start()
            )
            query.awaitTermination()
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        if not common.names_in(self.spark, out):  # a stream without any file makes no batch
            return keys, keys.select("digest", F.lit(0).cast("long").alias("n"), "doc_id", F.col("locator").alias("first")).limit(0)
        return keys, self.spark.read.parquet(out)


def digested(docs: DataFrame, id_col: str, text_col: str, digest: Column | None) -> DataFrame:
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    named = docs.select(docs[f"`{id_col}`"].alias("doc_id"), text.alias("text"))
    return named.withColumn("digest", F.sha2("text", 256) if digest is None else digest)


def classes(docs: DataFrame, state: DedupState | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size for each row, over all batches of the state so far. digest: an expression over text, for another
    one than SHA-256. Without a state there is no later batch."""
    spark = docs.sparkSession
    state = state or DedupState(spark, common.work_dir(spark), goes_on=False)
    if state.batches and not state.goes_on:
        raise ValueError("the state of a single batch keeps no texts that a later one could be compared with")
    rows = digested(docs, id_col, text_col, digest)
    keys, stays = state.add(rows.select("digest", "doc_id"))
    return _checked(spark, rows, keys, stays, state)


def _counted(rows: DataFrame) -> DataFrame:
    """One row for each text, compared byte by byte: how often, and the identifier that stays."""
    return rows.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))


def _checked(spark: SparkSession, rows: DataFrame, keys: DataFrame, stays: DataFrame, state: DedupState) -> DataFrame:
    """The classes after hits were grouped by their bytes, with the texts of earlier batches."""
    again = stays.where("n > 1")
    hits = again.select("digest")
    # a short hash of the digest finds the rows to look at; what it takes too many does no harm below
    short = F.xxhash64("digest").alias("h")
    hits = common.stored(hits.select(short), f"{state.folder}/hits-{state.batches}")
    of_hits = lambda df: common.matching(df.select("*", short), hits, "h", True).drop("h")
    if state.goes_on:
        _counted(rows).write.mode("overwrite").parquet(f"{state.folder}/texts/locator={state.batches}")
        first = again.agg(F.min("first")).first()[0]  # no text of a hit lies in a batch before
        met = of_hits(spark.read.parquet(f"{state.folder}/texts").where(F.col("locator") >= (state.batches if first is None else first)))
        groups = met.groupBy("digest", "text").agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"))
    elif hits.count() * 16 <= common.BROADCAST_BYTES:
        groups = _counted(of_hits(rows))
    else:  # a digest of very many rows costs each task one row
        groups = of_hits(_counted(rows))
    groups = common.stored(groups, f"{state.folder}/groups-{state.batches}")
    by_digest = groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("n").alias("group_size"), F.max("keep_id").alias("keep_id"))
    alone = stays.where("n = 1").select("digest", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"))
    settled = alone.unionByName(by_digest.where("texts = 1 and group_size > 1").drop("texts"))
    found = keys.join(settled, "digest").select("doc_id", "digest", "keep_id", "group_size")
    clashes = common.stored(by_digest.where("texts > 1").select("digest"), f"{state.folder}/clashes-{state.batches}")
    if clashes.isEmpty():
        return found
    apart = common.matching(rows, clashes, "digest", True).join(groups.withColumnRenamed("n", "group_size"), ["digest", "text"])
    return found.unionByName(apart.select("doc_id", "digest", "keep_id", "group_size"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
