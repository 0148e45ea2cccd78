"""op10: removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

Every window of 200 bytes samples one of its grams of 64 bytes, the one of least hash: equal windows sample at the same place, so that
the suffixes that begin at sampled grams, some 17 in 1000, are all that must be indexed. An entry has the suffix's first 8 bytes (lead),
the hash of its gram (key) and of its context (all bytes of the windows that sample it, in this document). A suffix array is a sorted run
of distinct (lead, key, context), with the number of entries and where one of them is. It is in the order of the suffixes to the depth of
8 bytes; suffixes alike so far are in the order of their grams' hashes, so that equal grams are neighbours, which is all that matching asks.

Documents come in batches. A batch gets its own suffix array and is merge-scanned against each existing level, in suffix order: a gram
that occurs there too, or twice in the batch, is a long match to be looked into. Then the array enters the family at level 0, and as long
as two arrays stand on one level, they merge into one on the next. A family is its folder: another session goes on where one stopped.

Of the matches, a context with two entries or more repeats as a whole, which its two hashes tell (128 bits). Contexts of one entry whose
key has other contexts are compared byte by byte: how far two agree to the left and right of the gram tells which windows they share. Keys
of at most GROUP contexts are worked out together; of those with more, every single window's hash is counted, so that no key's contexts
need ever be in one place.

A null text counts as empty. Offsets are bytes of the document's UTF-8; matches never cross documents, but count inside one. Equal texts
of 200 bytes or more are removed wholly, all of them; shorter ones stay. Very long texts are worked on in blocks, whole. doc_id identifies
a row and isn't null (rows without one are returned as they are, but others are compared with them). An empty table gives no rows. Other
columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import common, windows

#: Order of a suffix array.
ORDER = ("lead", "key", "context")
#: Bytes of a table, about, that make one batch.
BATCH_BYTES = 1 << 38
#: Contexts of a key that are compared with each other; repeated windows of a key that go to its contexts as one array.
GROUP, REPEATED = 64, 4096
WINDOW, GRAM, GRAMS = windows.WINDOW, windows.GRAM, windows.GRAMS


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and the n+1 places where they begin and the last one ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8), offsets - offsets[0]


def entries(docs: DataFrame) -> DataFrame:
    """lead, key, context, doc_id, at (of the gram), low, high (first and last start of its windows) of each sampled suffix of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, bounds = text_bytes(part.column("text"))
                found = windows.suffixes(data, bounds[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["lead"]), pa.array(found["key"].view(np.int64)), pa.array(found["context"].view(np.int64)), part.column("doc_id").take(pa.array(found["row"].astype(np.int64))), *(pa.array(found[k], pa.int32()) for k in ("at", "low", "high"))],
                    ["lead", "key", "context", "doc_id", "at", "low", "high"],
                )

    return common.map_arrow(docs, run, f"lead long, key long, context long, doc_id {dict(docs.dtypes)['doc_id']}, at int, low int, high int")


class Family:
    """Suffix arrays by level, in a folder that driver and executors share. An array is called array-<number>-<first>-<level>: it has all
    that the arrays from the first number to its own had, so that what a merge left behind that was broken off is known as such."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.levels: dict[int, str] = {}
        found = sorted((tuple(map(int, n.split("-")[1:])) for n in common.names_in(spark, folder) if n.startswith("array-")), reverse=True)
        self.made, until = max((n for n, _, _ in found), default=0), None
        for number, first, level in found:
            path = f"{folder}/array-{number}-{first}-{level}"
            if (until is None or number < until) and "_SUCCESS" in common.names_in(spark, path):
                self.levels[level], until = path, first

    def write(self, rows: DataFrame, level: int, first: int | None = None) -> str:
        self.made += 1
        path = f"{self.folder}/array-{self.made}-{first or self.made}-{level}"
        rows.sortWithinPartitions(*ORDER).write.parquet(path)
        return path

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def add(self, batch: DataFrame) -> DataFrame:
        """lead, key of the batch's matches with itself and with all batches before; the batch is in the family afterwards."""
        place = F.struct("doc_id", "at", "low", "high")
        path, level = self.write(batch.groupBy(*ORDER).agg(F.count("*").alias("n"), F.min(place).alias("place")), 0), 0
        own = self.read(path)
        matches = own.groupBy("lead", "key").agg(F.sum("n").alias("n")).where("n > 1").select("lead", "key")
        for old in self.levels.values():
            matches = matches.union(own.select("lead", "key").join(self.read(old).select("lead", "key"), ["lead", "key"], "left_semi"))
        found = common.stored(matches.distinct(), f"{self.folder}/matches-{self.made}")
        while level in self.levels:
            old = self.levels.pop(level)
            both, level = self.read(old).unionByName(self.read(path)), level + 1
            first = int(old.rpartition("/")[2].split("-")[2])
            merged = self.write(both.groupBy(*ORDER).agg(F.sum("n").alias("n"), F.min("place").alias("place")), level, first)
            common.remove(self.spark, old)
            common.remove(self.spark, path)
            path = merged
        self.levels[level] = path
        return found

    def contexts(self, matches: DataFrame) -> DataFrame:
        """key, context, n, place of all entries with these leads and keys."""
        wanted = matches.select("lead", "key").distinct()
        rows = None
        for path in self.levels.values():
            here = self.read(path).join(wanted, ["lead", "key"], "left_semi").drop("lead")
            rows = here if rows is None else rows.unionByName(here)
        return rows if len(self.levels) == 1 else rows.groupBy("key", "context").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def shared_windows(pieces: list[tuple[bytes, int]], wanted: list[bool]) -> list[np.ndarray]:
    """For contexts (bytes, place of the gram) of one key: which windows, by their distance to the gram, each wanted one shares with another."""
    m = len(pieces)
    left, right = np.empty((m, GRAMS), np.int16), np.empty((m, WINDOW + 1), np.int16)
    left[:], right[:] = -1 - np.arange(m)[:, None], -1 - np.arange(m)[:, None]  # beyond a context nothing agrees
    for i, (data, at) in enumerate(pieces):
        b = np.frombuffer(data, np.uint8)
        left[i, :at], right[i, : len(b) - at] = b[:at][::-1], b[at:]
    out = []
    distance = np.arange(GRAMS)
    for i in range(m):
        if not wanted[i]:
            out.append(np.empty(0, np.int64))
            continue
        others = np.arange(m) != i
        agree_left = (left[others] != left[i]).argmax(axis=1)
        agree_right = (right[others] != right[i]).argmax(axis=1)
        shared = (distance <= agree_left[:, None]) & (distance >= WINDOW - agree_right[:, None])
        out.append(np.flatnonzero(shared.any(axis=0)))
    return out


def merged_ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring window starts, as the bytes that they cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), (starts[np.append(cuts, len(starts) - 1)] + WINDOW).tolist(), strict=True))


def edge_spans(docs: DataFrame, edges: DataFrame, work: str) -> DataFrame:
    """doc_id, begin, end of what single contexts share with others of their keys. edges: key, n, m (contexts of the key), place."""
    kind = dict(docs.dtypes)["doc_id"]
    by_doc = edges.groupBy(F.col("place.doc_id").alias("id")).agg(F.collect_list(F.struct("key", F.col("n") == 1, F.col("m") <= GROUP, "place.at", "place.low", "place.high")).alias("edges"))
    by_doc = common.stored(by_doc, f"{work}/edges")
    texts = common.matching(docs, by_doc.select(F.col("id").alias("doc_id")), "doc_id", True)
    asked = texts.join(by_doc, F.col("doc_id") == F.col("id")).select("doc_id", "text", "edges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                data = text.encode()
                hashes = None
                for key, single, small, at, low, high in (e.values() for e in wanted):
                    if small:
                        out.append((True, key, doc, single, at, low, data[low : high + WINDOW], None))
                        continue
                    if hashes is None:
                        array = np.frombuffer(data, np.uint8)
                        hashes = np.concatenate([windows.hashes(piece)[1] for _, piece in windows.blocks(array)]).view(np.int64)
                    out.append((False, key, doc, single, at, low, None, hashes[low : high + 1].tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(CUT.names, row, strict=True)) for row in out], CUT)

    cut_type = pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    CUT = pa.schema([("small", pa.bool_()), ("key", pa.int64()), ("doc_id", cut_type), ("single", pa.bool_()), ("at", pa.int32()), ("low", pa.int32()), ("bytes", pa.binary()), ("windows", pa.list_(pa.int64()))])  # noqa: N806
    pieces = common.stored(common.map_arrow(asked, cut, f"small boolean, key long, doc_id {kind}, single boolean, at int, low int, bytes binary, windows array<long>"), f"{work}/pieces")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(group: list[dict]) -> list[tuple]:
            found = shared_windows([(g["bytes"], g["at"] - g["low"]) for g in group], [g["single"] for g in group])
            return [(g["doc_id"], b, e) for g, d in zip(group, found, strict=True) for b, e in merged_ranges(g["at"] - d[::-1])]

        group, key = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key and group:
                    out += spans(group)
                    group = []
                key = row["key"]
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], cut_type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["doc_id", "begin", "end"])
        if group:
            out = spans(group)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], cut_type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["doc_id", "begin", "end"])

    small = pieces.where("small").select("key", "doc_id", "single", "at", "low", "bytes")
    few = common.map_arrow(small.repartition("key").sortWithinPartitions("key"), compare, f"doc_id {kind}, begin long, end long")
    return few.unionByName(often_met(pieces.where("not small").drop("small", "bytes"), work))


def often_met(contexts: DataFrame, work: str) -> DataFrame:
    """doc_id, begin, end of what single contexts of keys with many contexts share: windows whose hash occurs twice under their key.
    contexts: key, doc_id, single, at, low, windows (their hashes, from low on).

    A context's windows begin less than a window's length apart, so that the first and the last that it shares cover all others. Where a
    key has at most REPEATED such hashes, they go to its contexts as one array; where it has more, each window looks for its own."""
    twice = contexts.select("key", F.explode("windows").alias("h")).groupBy("key", "h").count().where("count > 1").select(F.col("key").alias("k"), "h")
    twice = common.stored(twice, f"{work}/twice")
    sizes = twice.groupBy(F.col("k").alias("many")).count()
    short = twice.join(sizes.where(F.col("count") <= REPEATED), F.col("k") == F.col("many"), "left_semi").groupBy("k").agg(F.collect_list("h").alias("hs"))
    single = contexts.where("single")
    met = single.join(short, F.col("key") == F.col("k")).select("doc_id", "low", "windows", F.reverse("windows").alias("back"), F.array_intersect("windows", "hs").alias("first"), F.array_intersect(F.reverse("windows"), F.col("hs")).alias("last")).where(F.size("first") > 0)
    begin = F.col("low") + F.array_position("windows", F.col("first")[0]) - 1
    end = F.col("low") + F.size("windows") - F.array_position("back", F.col("last")[0]) + WINDOW
    arrays = met.select("doc_id", begin.cast("long").alias("begin"), end.cast("long").alias("end"))
    long = twice.join(sizes.where(F.col("count") > REPEATED), F.col("k") == F.col("many"), "left_semi")
    each = single.select("key", "doc_id", "at", "low", F.posexplode("windows").alias("i", "w")).join(long, (F.col("key") == F.col("k")) & (F.col("w") == F.col("h")), "left_semi")
    place = F.col("low") + F.col("i")
    rows = each.groupBy("doc_id", "at", "low").agg(F.min(place).cast("long").alias("begin"), (F.max(place) + WINDOW).cast("long").alias("end")).select("doc_id", "begin", "end")
    return arrays.unionByName(rows)


def batches_for(docs: DataFrame) -> int:
    """How many batches a table is added in: by its size, two at least."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(2, -(-size // BATCH_BYTES))


def repeated_spans(docs: DataFrame, work: str, batches: int | None = None) -> DataFrame:
    """doc_id, begin, end of repeated bytes; spans of a document may overlap. docs: doc_id, text."""
    batches = batches or batches_for(docs)
    family, matches = Family(docs.sparkSession, f"{work}/family"), None
    for b in range(batches):
        found = family.add(entries(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)))
        matches = found if matches is None else matches.union(found)
    contexts = common.stored(family.contexts(matches), f"{work}/contexts")
    of_key = contexts.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    edges = contexts.join(of_key, F.col("key") == F.col("k")).select("key", "n", "m", "place")
    whole = contexts.where("n > 1").select(F.col("key").alias("k"), F.col("context").alias("c"))
    again = entries(docs).join(whole, (F.col("key") == F.col("k")) & (F.col("context") == F.col("c")), "left_semi")
    full = again.select("doc_id", F.col("low").cast("long").alias("begin"), (F.col("high") + WINDOW).cast("long").alias("end"))
    return full.unionByName(edge_spans(docs, edges, work))


def without_repeats(docs: DataFrame, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (begin, end, apart and in order), kept (the remaining bytes) for each row."""
    spark = docs.sparkSession
    work = common.work_dir(spark)
    named = common.renamed(docs, {"doc_id": id_col, "text": text_col})
    kind = dict(named.dtypes)["doc_id"]
    spans = common.stored(repeated_spans(named, work, batches).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("begin", "end")).alias("spans")), f"{work}/spans")
    ids = spans.select(F.col("id").alias("doc_id"))
    hit = common.matching(named, ids, "doc_id", True).join(spans, F.col("doc_id") == F.col("id")).select("doc_id", "text", "spans")
    clean = common.matching(named, ids, "doc_id", False)
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            spans, kept = [], []
            for data, own in zip(texts, batch.column("spans").to_pylist(), strict=True):
                joined: list[list[int]] = []
                for begin, end in sorted((s["begin"], s["end"]) for s in own):
                    if joined and begin <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], end)
                    else:
                        joined.append([begin, end])
                spans.append([{"begin": b, "end": e} for b, e in joined])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(e for _, e in joined)], [*(b for b, _ in joined), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    none = F.expr("cast(array() as array<struct<begin: long, end: long>>)")
    return common.map_arrow(hit, cut, schema).unionByName(clean.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("spans"), text.alias("kept")))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
