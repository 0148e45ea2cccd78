"""op7: packing documents into sequences of a fixed number of tokens, planned on the histogram of lengths.

Every document becomes its ids and an end id; only one longer than a sequence is cut, into pieces of a whole sequence and a rest.
Best fit, longest first, runs over counts: a length that c pieces have meets bins that stand as (first bin, how many, room), so one
step places many pieces, and the plan grows with the number of lengths and not of documents. Pieces of a length are equal to the plan:
each takes the slot of its rank, which is its rank in its input partition plus the pieces of that length in the partitions before.

A null or empty text is a document of the end id alone. Equal texts are packed like any others; an empty table gives no rows. Other
columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stitchwork.llm import bpe, common, words

CAPACITY = 2048
END_ID = 0
#: Ranks of a length that one key of the join with the plan has.
BLOCK = 4096
PLAN = "length int, first long, n long, bin long, per_bin long, at long"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first bin, pieces per bin, offset): piece first+j goes to bin + j // per_bin, at offset + (j % per_bin) * length."""
    rooms: list[int] = []  # sorted
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, used = [], 0

    def put(room: int, begin: int, n: int) -> None:
        if n and room:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append((begin, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if (i := bisect_left(rooms, length)) < len(rooms):
                room = rooms[i]
                begin, n = bins[room].pop()
                if not bins[room]:
                    rooms.pop(i)
            else:
                room, begin = capacity, used
                n = -(-left // (capacity // length))
                used += n
            per_bin = room // length
            take = min(left, n * per_bin)
            rows.append((length, rank, take, begin, per_bin, capacity - room))
            full, part = divmod(take, per_bin)
            put(room - per_bin * length, begin, full)
            put(room - part * length, begin + full, 1 if part else 0)
            put(room, begin + full + bool(part), n - full - bool(part))
            rank, left = rank + take, left - take
    return rows


def planned(spark: SparkSession, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """The plan's rows as a table. They go over as Arrow: of a list, each executor would start more Python workers only to copy it."""
    columns = np.array(rows, np.int64).reshape(-1, len(PLAN.split(","))).T
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], [c.split()[0] for c in PLAN.split(",")]), PLAN)


def token_pieces(texts: list[str], path: str, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids, each document's end id among them, and of each piece: row, number, start in the document, length."""
    ids, bounds = bpe.vocabulary(path).encode(texts)
    ids = np.insert(ids, bounds[1:], END_ID)
    sizes = np.diff(bounds) + 1
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    number = words.ragged(np.zeros(len(n), np.int64), n)
    start = number * capacity
    return ids, row, number, start, np.minimum(capacity, sizes[row] - start)


def measured(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with its input partition and its rank there among the pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in common.slices(batch, "text"):
                ids, row, number, start, length = token_pieces(common.texts(rows.column("text")), path, capacity)
                ends = np.cumsum(length)
                flat = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(length[order]) != 0))
                counts = np.diff(np.append(heads, len(order)))
                rank = np.empty(len(length), np.int64)
                rank[order] = words.ragged(seen[length[order[heads]]], counts)
                seen[length[order[heads]]] += counts
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    kind = dict(docs.dtypes)[id_col]
    return common.map_arrow(common.renamed(docs, {"doc_id": id_col, "text": text_col}), run, f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    # stored: the rank in a partition holds for the rows as they were read this once
    pieces = common.stored(measured(docs, path, capacity, id_col, text_col), f"{common.work_dir(spark)}/pieces")
    runs = pieces.groupBy("part", "length").count()
    histogram = {r.length: r["sum(count)"] for r in runs.groupBy("length").sum("count").collect()}  # at most a row for each length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    slots = planned(spark, plan(histogram, capacity)).withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + n - 1) div {BLOCK})"))).withColumnRenamed("length", "slot_length").withColumnRenamed("rank", "slot_rank")
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).withColumn("rank_block", F.expr(f"rank div {BLOCK}"))
    place = F.col("rank") - F.col("first")
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank_block") == F.col("block")) & (place >= 0) & (place < F.col("n"))
    return ranked.join(slots, here).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("bin") + F.expr("(rank - first) div per_bin")).alias("sequence_id"), (F.col("at") + place % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
