"""What the operators share: tables, the shared work folder, Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch, and characters that one call of a numpy kernel gets (one longer text is a call of its own).
BATCH_ROWS = 2000
KERNEL_CHARS = 1_000_000
#: The most bytes that an operator broadcasts; beyond it the same rows are joined by a shuffle.
BROADCAST_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith(("local-cluster", "spark:", "yarn", "k8s:", "mesos:")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stitchwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return "/".join([base.rstrip("/"), "stitchwork", *_scopes, uuid.uuid4().hex])


_scopes: list[str] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders for steps that are made inside are removed at its end, when what was made of them is stored."""
    folder = work_dir(spark)
    _scopes.append(folder.rpartition("/")[2])
    try:
        yield
    finally:
        _scopes.pop()
        remove(spark, folder)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written to Parquet and read again: cuts the lineage and outlives a lost executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(p)] if system.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of an operator's own that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def renamed(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the columns that an operator needs, under its own names: others, whatever they are called, stay out of its joins."""
    return docs.select(*(docs[f"`{old}`"].alias(new) for new, old in columns.items()))


def trim() -> None:
    """Gives memory that a worker holds but does not use back to the system: workers live on, and their next task may be of another kind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    if int(old) <= 0 or int(old) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = KERNEL_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together stay below a size, but for one longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def matching(rows: DataFrame, keys: DataFrame, on: str, keep: bool) -> DataFrame:
    """The rows whose id is among the keys (keep), or is not. The keys are broadcast only after a count shows that they stay
    below BROADCAST_BYTES; more of them meet the rows by a shuffle."""
    how = "left_semi" if keep else "left_anti"
    small = keys.count() * 16 <= BROADCAST_BYTES
    return rows.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), on, how)
