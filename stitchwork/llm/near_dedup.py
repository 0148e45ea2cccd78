"""op9: near-duplicates by bottom-k sketches of one hash function.

A document is the set of its distinct runs of five words, hashed to 64 bits; its sketch is the K smallest hashes. Documents with equal
sets form a class, and one of them, the smallest doc_id, goes on. Inverted lists of the sketches' values give candidates. Two documents
with a Jaccard similarity of 0.75 share at least `need` values of their sketches, all but surely (for sets below 3/4 of K surely; else
29 of 64 where 48 are expected, under one miss in ten million), so that each document enters only the lists of its rarest values, all
but need-1 of them: passages that many documents share make no long lists.

The pairs of short lists are candidates. Of long lists no pairs are made: documents gather at their longest list, and those that gather
at one are compared with those at another if the two have a document in common, in tiles of some against some, which give back only
links enough to join what is linked. Where many gather, all are measured against one of them first, and what that settles is not compared
again. So no link between different texts is lost. Candidates must share enough of the K smallest values of
their union, and what is left is confirmed on the full sets of hashes.

Lower case is for A-Z only. With fewer than five words, the whole sequence is the only shingle; without words (or for a null or empty
text) the set is empty, linked with nothing, and the document is kept. Equal texts have equal sets. doc_id identifies a row; rows with a
null doc_id are linked with nothing and not kept. Very long texts are read whole. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import common, components, words

SHINGLE, PERCENT = 5, 75
K = 64
#: Least values of two sketches of K values that documents at the threshold share: 48 less 5.5 standard deviations.
NEED = 29
#: The most members of a short list.
SHORT_LIST = 24
#: Documents on either side of a tile, about.
TILE = 256
#: Groups by distance from a pivot, from 0 to 1.
BANDS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and the n+1 places where each text's words begin and the last's end."""
    joined = "\n".join(texts) + "\n"
    points = words.code_points(joined)
    points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint32)
    solid = (points != 32) & ((points < 9) | (points > 13))
    begins = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    bounds = np.append(0, np.searchsorted(begins, ends))
    if not len(begins):
        return np.empty(0, np.uint64), bounds
    found, codes = words.distinct(points[solid], (np.cumsum(solid) - 1)[begins])
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found.to_pylist()), np.uint64, len(found))[codes], bounds


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    hashes, bounds = word_hashes(texts)
    run = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE if len(run) else 0):
        run = run * MULTIPLIER + hashes[i : i + len(run)]
    run = mixed(run)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= SHINGLE:
            yield np.unique(run[begin : end - SHINGLE + 1])
        elif end > begin:
            yield np.frombuffer(xxhash.xxh3_64_digest(hashes[begin:end].tobytes()), np.uint64)
        else:
            yield run[:0]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes, of the whole set), sketch (as signed numbers of the same order) for each row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = list(shingle_sets(common.texts(part.column("text"))))
                bottoms = [s[:K] for s in sets]
                values = (np.concatenate(bottoms) ^ np.uint64(1 << 63)).view(np.int64)
                bounds = np.append(0, np.cumsum([len(b) for b in bottoms]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))],
                    ["doc_id", "n_shingles", "set_hash", "sketch"],
                )

    return common.map_arrow(common.renamed(docs, {"doc_id": id_col, "text": text_col}), run, f"doc_id {kind}, n_shingles long, set_hash binary, sketch array<long>")


def need(n: Column) -> Column:
    """Least values that the sketch of a set of n shares with that of a linked one."""
    return F.when(n < K * PERCENT // 100, F.ceil(n * PERCENT / 100)).otherwise(NEED)


def least_shared(n: int) -> int:
    """The same, of a number."""
    return -(-n * PERCENT // 100) if n < K * PERCENT // 100 else NEED


def prefixes(reps: DataFrame) -> DataFrame:
    """value, doc_id, n: each document in the lists of its rarest shared values."""
    values = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1").withColumnRenamed("value", "v")
    shared = values.join(often, F.col("value") == F.col("v")).groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("shared"))
    enter = F.size("shared") - need(F.col("n")) + 1
    return shared.where(enter > 0).select("doc_id", "n", F.explode(F.slice("shared", F.lit(1), enter.cast("int"))).alias("s")).select("s.value", "doc_id", "n")


def full_sets(texts: DataFrame) -> DataFrame:
    """doc_id, shingles (sorted, signed numbers of the order of the hashes) of doc_id, text."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = list(shingle_sets(common.texts(part.column("text"))))
                values = (np.concatenate(sets) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32()), pa.array(values))], ["doc_id", "shingles"])

    return common.map_arrow(texts, run, f"doc_id {kind}, shingles array<long>")


class Sets:
    """Some documents' shingles as small numbers, in the order of their hashes, in one array."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms = np.unique(np.concatenate(sets), return_inverse=True)[1]
        # sketches: the first K of each set
        self.low_sizes = np.minimum(self.sizes, K)
        self.low_starts = np.cumsum(self.low_sizes) - self.low_sizes
        self.low = self.terms[words.ragged(self.starts, self.low_sizes)]
        self.low_place = words.ragged(np.zeros(len(sets), np.int64), self.low_sizes)
        self.rank = np.full(int(self.terms.max()) + 1, -1)
        self.least = np.array([least_shared(n) for n in self.sizes.tolist()])

    def linked(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that a is linked with: enough of the K smallest of the union in both, and then of the sets themselves."""
        own = self.terms[self.starts[a] : self.starts[a] + self.sizes[a]]
        x, y = self.sizes[a], self.sizes[others]
        others = others[100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)]
        if not len(others):
            return others
        self.rank[own] = np.arange(len(own))
        n = self.low_sizes[others]
        at = words.ragged(self.low_starts[others], n)
        rank = self.rank[self.low[at]]
        common = (rank >= 0) & (rank < K)
        heads = np.cumsum(n) - n
        before = np.cumsum(common) - common
        # place in the union: those before in either, less those in both
        place = rank + self.low_place[at] - (before - np.repeat(before[heads], n))
        likely = np.add.reduceat(common & (place < K), heads) >= np.maximum(self.least[a], self.least[others])
        others = others[likely]
        if len(others):
            n = self.sizes[others]
            both = np.add.reduceat(self.rank[self.terms[words.ragged(self.starts[others], n)]] >= 0, np.cumsum(n) - n)
            others = others[100 * both >= PERCENT * (x + n - both)]
        self.rank[own] = -1
        return others


def forest(sets: list[np.ndarray], first: int) -> Iterator[tuple[int, int]]:
    """Links enough to join what is linked: of the first sets with all the others, or among all of them if there are no others."""
    found, component = Sets(sets), np.arange(len(sets))
    for a in range(first):
        rest = np.arange(first if first < len(sets) else a + 1, len(sets))
        for b in found.linked(a, rest[component[rest] != component[a]]).tolist():
            if component[a] != component[b]:
                component[component == component[b]] = component[a]
                yield a, b


def dealt(rows: DataFrame, kind: str) -> DataFrame:
    """Links (a, b) found tile by tile. rows: tile, a, b, side, shingles: sets of documents a (side 0 or 1; b null) or pairs (side 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, wanted, tile, id_type = ({}, {}), [], None, None

        def result() -> pa.RecordBatch:
            numbers = {d: i for i, d in enumerate(sides[0] | sides[1])}
            ids, sets = list(numbers), [*sides[0].values(), *sides[1].values()]
            if wanted:
                partners: dict[int, list[int]] = {}
                for a, b in wanted:
                    partners.setdefault(numbers[a], []).append(numbers[b])
                compared = Sets(sets)
                found = [(a, b) for a, others in partners.items() for b in compared.linked(a, np.array(others)).tolist()]
            else:
                found = list(forest(sets, len(sides[0]))) if sides[0] else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], id_type), pa.array([ids[b] for _, b in found], id_type)], ["a", "b"])

        for batch in batches:
            id_type = batch.schema.field("a").type
            shingles = batch.column("shingles")
            flat, offsets = shingles.values.to_numpy(zero_copy_only=False), shingles.offsets.to_numpy()
            for i, (t, a, b, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "a", "b", "side")), strict=True)):
                if t != tile:
                    if tile is not None:
                        yield result()
                    sides, wanted, tile = ({}, {}), [], t
                if side < 2:
                    sides[side][a] = flat[offsets[i] : offsets[i + 1]].copy()
                else:
                    wanted.append((a, b))
        if tile is not None:
            yield result()

    return common.map_arrow(rows.repartition("tile").sortWithinPartitions("tile", "side"), run, f"a {kind}, b {kind}")


def short_links(lists: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (a, b) from the pairs of short lists, each pair looked at once. lists: value, doc_id, n; chosen: doc_id, shingles."""
    kind = dict(lists.dtypes)["doc_id"]
    other = lists.select(F.col("value").alias("v"), F.col("doc_id").alias("b"), F.col("n").alias("n_b"))
    alike = (F.col("value") == F.col("v")) & (F.col("doc_id") < F.col("b")) & (100 * F.least("n", "n_b") >= PERCENT * F.greatest("n", "n_b"))
    pairs = lists.join(other, alike).groupBy(F.col("doc_id").alias("a"), "b").agg(F.min("value").alias("tile"))
    members = pairs.select("tile", "a").union(pairs.select("tile", "b")).distinct()
    sets = members.join(chosen, F.col("a") == F.col("doc_id")).select("tile", "a", F.lit(None).cast(kind).alias("b"), F.lit(0).alias("side"), "shingles")
    return dealt(sets.unionByName(pairs.select("tile", "a", "b", F.lit(2).alias("side"), F.lit(None).cast("array<long>").alias("shingles"))), kind)


def measured(rows: DataFrame, kind: str) -> DataFrame:
    """(a, b, far, linked): for each tile the distance, 1 less the Jaccard similarity, of its document of side 0 from all those of side 1.
    rows: tile, a, side, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, first, own = None, None, None
        for batch in batches:
            shingles, ids = batch.column("shingles"), batch.column("a")
            flat, offsets = shingles.values.to_numpy(zero_copy_only=False), shingles.offsets.to_numpy()
            begin, a, far, linked = [], [], [], []
            for i, (t, doc, side) in enumerate(zip(batch.column("tile").to_pylist(), ids.to_pylist(), batch.column("side").to_pylist(), strict=True)):
                values = flat[offsets[i] : offsets[i + 1]]
                if side == 0:
                    tile, first, own = t, doc, values.copy()
                elif t == tile:
                    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    both = int((own[at] == values).sum())
                    union = len(own) + len(values) - both
                    begin.append(i)
                    a.append(first)
                    far.append(1 - both / union)
                    linked.append(100 * both >= PERCENT * union)
            yield pa.RecordBatch.from_arrays([pa.array(a, ids.type), ids.take(pa.array(begin, pa.int64())), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "far", "linked"])

    return common.map_arrow(rows.repartition("tile").sortWithinPartitions("tile", "side"), run, f"a {kind}, b {kind}, far double, linked boolean")


def long_links(lists: DataFrame, chosen: DataFrame, work: str) -> DataFrame:
    """Links (a, b) enough to join what is linked in long lists, without making their pairs. lists: value, doc_id, n, m (the list's size).

    A document's home is its longest list. Homes that meet in a list are compared, all members of one with all of the other, in tiles of
    some members against some: few homes stand for many lists that have mostly the same members.

    Members of a home of more than one tile are first measured against one of them, its pivot, and grouped by their distance from it.
    Members linked with the pivot need no comparison with each other, nor with those linked with a pivot that is linked with it; and as
    distances are a metric, groups need none whose distances from the pivots differ too much, or whose pivots are too far apart. What is
    left of a large group of near copies are the documents around its edge.
    """
    kind = dict(lists.dtypes)["doc_id"]
    homes = lists.groupBy("doc_id").agg(F.max(F.struct("m", "value")).getField("value").alias("home"))
    sizes = common.stored(homes.groupBy(F.col("home").alias("h")).agg(F.count("*").alias("size"), F.min("doc_id").alias("pivot")), f"{work}/home-sizes")
    homes = common.stored(homes.join(sizes, F.col("home") == F.col("h")).drop("h"), f"{work}/homes")
    with_set = lambda rows: rows.join(chosen, F.col("a") == F.col("doc_id")).drop("doc_id")

    large = homes.where(F.col("size") > TILE)
    spread = F.xxhash64("home", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("size") / TILE))).alias("tile")
    members = large.select(spread, F.col("doc_id").alias("a"), F.lit(1).alias("side"))
    pivots = large.select(spread, F.col("pivot").alias("a"), F.lit(0).alias("side")).distinct()
    near = common.stored(measured(with_set(members.union(pivots)), kind), f"{work}/from-pivots")
    banded = homes.join(near.select(F.col("b").alias("m"), "far", "linked"), F.col("doc_id") == F.col("m"), "left")
    band = F.when(F.col("far").isNull(), -1).otherwise(2 * F.floor(F.col("far") * BANDS) + F.col("linked").cast("int")).cast("int")
    banded = common.stored(banded.select("doc_id", "home", band.alias("band")), f"{work}/banded")
    groups = common.stored(banded.groupBy(F.col("home").alias("h"), F.col("band").alias("g")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), f"{work}/groups")
    placed = banded.join(groups, (F.col("home") == F.col("h")) & (F.col("band") == F.col("g"))).drop("h", "g").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts")).cast("int"))
    placed = common.stored(placed, f"{work}/placed")

    met = lists.select("value", "doc_id").join(homes.select("doc_id", "home", "size", "pivot"), "doc_id").select("value", "home", "size", "pivot").distinct()
    other = met.select(F.col("value").alias("v"), *(F.col(c).alias(f"{c}_b") for c in ("home", "size", "pivot")))
    meet = met.join(other, (F.col("value") == F.col("v")) & (F.col("home") <= F.col("home_b"))).drop("value", "v").withColumnsRenamed({c: f"{c}_a" for c in ("home", "size", "pivot")}).distinct()
    meet = common.stored(meet, f"{work}/meet")
    both_large = meet.where((F.col("size_a") > TILE) & (F.col("size_b") > TILE) & (F.col("home_a") != F.col("home_b")))
    ends = both_large.select(F.col("home_a").alias("tile"), F.col("pivot_b").alias("a"), F.lit(1).alias("side")).union(both_large.select(F.col("home_a").alias("tile"), F.col("pivot_a").alias("a"), F.lit(0).alias("side"))).distinct()
    apart = common.stored(measured(with_set(ends), kind), f"{work}/pivots")
    known = meet.join(apart, (F.col("pivot_a") == F.col("a")) & (F.col("pivot_b") == F.col("b")), "left")
    same = F.col("home_a") == F.col("home_b")
    known = known.select("home_a", "home_b", F.when(same, 0.0).otherwise(F.col("far")).alias("far"), F.when(same, True).otherwise(F.coalesce("linked", F.lit(False))).alias("linked"))
    side = lambda x: groups.select(F.col("h").alias(f"h_{x}"), F.col("g").alias(f"g_{x}"), F.col("parts").alias(f"parts_{x}"))
    pairs = known.join(side("a"), F.col("home_a") == F.col("h_a")).join(side("b"), F.col("home_b") == F.col("h_b")).drop("h_a", "h_b")
    near_edge = lambda x: F.floor(F.col(f"g_{x}") / 2) / BANDS - 1e-9
    far_edge = lambda x: (F.floor(F.col(f"g_{x}") / 2) + 1) / BANDS + 1e-9
    least = F.greatest(near_edge("b") - far_edge("a") - F.col("far"), near_edge("a") - far_edge("b") - F.col("far"), F.col("far") - far_edge("a") - far_edge("b"))
    in_bands = (F.col("g_a") >= 0) & (F.col("g_b") >= 0) & F.col("far").isNotNull()
    joined = (F.col("g_a") % 2 == 1) & (F.col("g_b") % 2 == 1) & F.col("linked")
    needed = ~F.coalesce(in_bands & ((least > 1 - PERCENT / 100) | joined), F.lit(False)) & ((F.col("home_a") != F.col("home_b")) | (F.col("g_a") <= F.col("g_b")))
    pairs = common.stored(pairs.where(needed).drop("far", "linked"), f"{work}/group-pairs")

    alone = (F.col("home_a") == F.col("home_b")) & (F.col("g_a") == F.col("g_b"))
    at = lambda x: (F.col("home") == F.col(f"home_{x}")) & (F.col("band") == F.col(f"g_{x}"))
    left = placed.drop("parts").join(pairs, at("a")).withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence(F.when(alone, F.col("i")).otherwise(0), F.col("parts_b") - 1)))
    right = placed.drop("parts").join(pairs, at("b")).withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0), F.when(alone, F.col("j")).otherwise(F.col("parts_a") - 1))))
    tile = F.xxhash64("home_a", "g_a", "home_b", "g_b", "i", "j").alias("tile")
    compared = left.select(tile, F.col("doc_id").alias("a"), F.lit(0).alias("side")).union(right.where(~(alone & (F.col("i") >= F.col("j")))).select(tile, F.col("doc_id").alias("a"), F.lit(1).alias("side")))
    sets = with_set(compared).select("tile", "a", F.lit(None).cast(kind).alias("b"), "side", "shingles")
    return dealt(sets, kind).unionByName(near.where("linked").select("a", "b")).unionByName(apart.where("linked").select("a", "b"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row. work: a folder for steps, which the result still reads."""
    spark = docs.sparkSession
    work = work or common.work_dir(spark)
    all_ = common.stored(sketches(docs, id_col, text_col), f"{work}/sketches")
    sets = common.stored(all_.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep")), f"{work}/sets")
    membership = all_.select("doc_id", "n_shingles", "set_hash").join(sets.withColumnRenamed("set_hash", "s"), F.col("set_hash") == F.col("s"), "left")
    membership = common.stored(membership.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), f"{work}/membership")
    copies = membership.where("doc_id != rep").select("doc_id").distinct()
    reps = common.matching(all_.where("n_shingles > 0 and doc_id is not null"), copies, "doc_id", False)
    lists = common.stored(prefixes(reps), f"{work}/prefixes")
    lengths = lists.groupBy(F.col("value").alias("v")).agg(F.count("*").alias("m")).where("m > 1")
    lists = common.stored(lists.join(lengths, F.col("value") == F.col("v")).drop("v"), f"{work}/lists")
    ids = common.stored(lists.select("doc_id").distinct(), f"{work}/chosen-ids")
    texts = common.matching(common.renamed(docs, {"doc_id": id_col, "text": text_col}), ids, "doc_id", True)
    chosen = common.stored(full_sets(texts).dropDuplicates(["doc_id"]), f"{work}/chosen")
    links = short_links(lists.where(F.col("m") <= SHORT_LIST), chosen).unionByName(long_links(lists.where(F.col("m") > SHORT_LIST), chosen, work))
    labels = components.connected(common.stored(links, f"{work}/links"), f"{work}/components")
    return membership.join(labels, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(common.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
