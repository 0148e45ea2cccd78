"""Scores of results against a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.operators import relational
from stitchwork.operators.ranking import assignment


def _prf(df: DataFrame, correct: str = "correct", created: str = "created", total: str = "total") -> DataFrame:
    p, r = F.try_divide(correct, created), F.try_divide(correct, total)
    f = F.try_divide(2 * p * r, p + r)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return df.withColumns({"precision": zero(p), "recall": zero(r), "f1": zero(f)})


def pairwise(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of pairs of members. Pairs are counted and not made: n(n-1)/2 of a cluster's n. gold, found: id, cluster."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    both = gold.join(found.withColumnRenamed("cluster", "f"), "id").groupBy("cluster", "f").agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias("correct"))
    size = lambda d, name: d.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.sum(pairs("n")).alias(name))
    one = lambda d: d.withColumn("one", F.lit(1))
    joined = one(both).join(one(size(found, "created")), "one").join(one(size(gold, "total")), "one").drop("one")
    return _prf(joined.select(*(F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("correct", "created", "total"))))


def overlaps(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(g, f, common) of gold and found clusters."""
    return gold.select("id", F.col("cluster").alias("g")).join(found.select("id", F.col("cluster").alias("f")), "id").groupBy("g", "f").agg(F.count("*").alias("common"))


def cluster_scores(common: list[tuple], sizes: dict) -> dict[str, float]:
    """Gold clusters by falling size, each with the free found cluster it overlaps most. common: (g, f, n); sizes: ('g'|'f', id) -> n."""
    used, correct = set(), 0
    for g in sorted((i for k, i in sizes if k == "g"), key=lambda g: (-sizes["g", g], str(g))):
        free = [(n, f) for x, f, n in common if x == g and f not in used]
        if free:
            n, f = max(free, key=lambda o: (o[0], str(o[1])))
            used.add(f)
            correct += n
    created, total = (sum(n for (k, _), n in sizes.items() if k == kind) for kind in "fg")
    p, r = correct / created if created else 0.0, correct / total if total else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def muc(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Sum of (|S| - parts of S) over sum of (|S| - 1), for gold clusters and parts by found ones (recall), and the other way round."""

    def one(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        placed = a.join(b.select("id", F.col("cluster").alias("other")), "id", "left")
        alone = F.sum(F.col("other").isNull().cast("int"))
        s = placed.groupBy("cluster").agg(F.count("*").alias("n"), (F.countDistinct("other") + alone).alias("parts"))
        return s.agg(F.round(F.try_divide(F.sum(F.col("n") - F.col("parts")), F.sum(F.col("n") - 1)), 6).alias(name)).withColumn("one", F.lit(1))

    return one(gold, found, "muc_recall").join(one(found, gold, "muc_precision"), "one").drop("one")


def averages(counts: DataFrame) -> DataFrame:
    """Micro, macro and weighted F1 over classes. counts: correct, created, total."""
    scored = _prf(counts)
    sums = scored.agg(F.sum("correct").alias("correct"), F.sum("created").alias("created"), F.sum("total").alias("total"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.try_divide(F.sum(F.col("f1") * F.col("total")), F.sum("total")), 6).alias("weighted_f1"))
    return _prf(sums).select(F.col("f1").alias("micro_f1"), "macro_f1", "weighted_f1")


def classification(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per class correct, created, total, precision, recall, F1. gold, found: id, class."""
    both = gold.select("id", F.col("class").alias("g")).join(found.select("id", F.col("class").alias("f")), "id", "full")
    votes = both.select("id", F.explode(F.array_distinct(F.array_compact(F.array("g", "f")))).alias("class"), "g", "f")
    is_ = lambda c: F.coalesce((F.col(c) == F.col("class")), F.lit(False)).cast("int")
    counts = votes.groupBy("class").agg(F.sum(is_("g") * is_("f")).alias("correct"), F.sum(is_("f")).alias("created"), F.sum(is_("g")).alias("total"))
    return _prf(counts)


def containment(reference: DataFrame, extracted: DataFrame) -> DataFrame:
    """Of each reference table the share of its cells that the best extracted table has. Both: table, row (text of the key), column, v."""
    ref = reference.groupBy(F.col("table").alias("t")).agg(F.count("*").alias("cells"))
    met = reference.join(extracted.select(F.col("table").alias("e"), "row", "column", F.col("v").alias("w")), ["row", "column"]).where("v = w").groupBy("table", "e").agg(F.count("*").alias("common"))
    best = met.groupBy("table").agg(F.max("common").alias("common"))
    return ref.join(best, F.col("t") == F.col("table"), "left").select(F.col("t").alias("table"), "cells", F.round(F.coalesce("common", F.lit(0)) / F.col("cells"), 6).alias("recall"))


def relation_scores(reference: DataFrame, extracted: DataFrame) -> DataFrame:
    """(table, extracted, correct, created, total, precision, recall, f1) of each reference table and the extracted one that it is
    mapped to: tables by a maximum matching on their common cells, rows by their keys. A reference table without one has zeros.
    Both: table, row, column, v."""
    from stitchwork.operators.ranking import maximum_matching

    met = reference.join(extracted.select(F.col("table").alias("e"), "row", "column", F.col("v").alias("w")), ["row", "column"]).where("v = w")
    common = met.groupBy("table", "e").agg(F.count("*").cast("double").alias("score"))  # a row for each pair of tables
    chosen = maximum_matching(common.select(F.lit(0).alias("all"), F.col("table").alias("l"), F.col("e").alias("r"), "score"), ["all"])
    size = lambda d, x, n: d.groupBy(F.col("table").alias(x)).agg(F.count("*").alias(n))
    both = size(reference, "l", "total").join(chosen.select("l", "r", "score"), "l", "left").join(size(extracted, "r", "created"), "r", "left")
    counts = both.select(F.col("l").alias("table"), F.col("r").alias("extracted"), F.coalesce("score", F.lit(0.0)).alias("correct"), F.coalesce("created", F.lit(0)).alias("created"), "total")
    return _prf(counts)


def table_scores(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of column clusters (components of edges) against gold clusters (id, cluster), by pairs."""
    from stitchwork.operators.graph import components

    found = components(edges.select("l", "r")).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return pairwise(gold, found)


def bake_off(matchers: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """(matcher, correct, created, total, precision, recall, f1) of each matcher's edges (l, r) against gold pairs (l, r)."""
    pair = lambda d: d.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    right = pair(gold).withColumn("right", F.lit(1))
    all_ = None
    for name in sorted(matchers):
        one = pair(matchers[name]).select(F.lit(name).alias("matcher"), "l", "r")
        all_ = one if all_ is None else all_.unionByName(one)
    counts = all_.join(right, ["l", "r"], "left").groupBy("matcher").agg(F.count("right").alias("correct"), F.count("*").alias("created"))
    total = right.agg(F.count("*").alias("total"))
    return _prf(counts.withColumn("total", total.scalar()))


def column_class_scores(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: of all candidates precision and the largest recall, of each column's best candidate precision, recall and F1, recall
    over the distinct columns of the gold standard. candidates: col_id, class, score; gold: col_id, class (a column may have several)."""
    from pyspark.sql import Window

    right = gold.select("col_id", "class", F.lit(1).alias("right")).distinct()
    first = F.row_number().over(Window.partitionBy("col_id").orderBy(F.desc("score"), "class"))
    marked = candidates.join(right, ["col_id", "class"], "left").withColumn("top", (first == 1).cast("int"))
    n = gold.agg(F.countDistinct("col_id").alias("n"))
    sums = marked.agg(
        F.count("right").alias("all_correct"), F.count("*").alias("all_created"), F.countDistinct(F.when(F.col("right") == 1, F.col("col_id"))).alias("reached"),
        F.coalesce(F.sum(F.when(F.col("right") == 1, F.col("top"))), F.lit(0)).alias("correct"), F.coalesce(F.sum("top"), F.lit(0)).alias("created"),
    ).withColumn("total", n.scalar())
    six = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return _prf(sums).select(six("all_correct", "all_created").alias("all_precision"), six("reached", "total").alias("max_recall"), "precision", "recall", "f1")


def weighted_macro(scores: DataFrame) -> DataFrame:
    """Mean recall and the mean weighted by cells."""
    return scores.agg(F.round(F.avg("recall"), 6).alias("macro"), F.round(F.try_divide(F.sum(F.col("recall") * F.col("cells")), F.sum("cells")), 6).alias("weighted"))


def best_mapping(common: list[tuple]) -> list[tuple]:
    """The one-to-one mapping (g, f, n) with the largest sum."""
    left, right = sorted({g for g, _, _ in common}), sorted({f for _, f, _ in common})
    n = {(g, f): c for g, f, c in common}
    return [(left[i], right[j], n[left[i], right[j]]) for i, j in enumerate(assignment([[float(n.get((g, f), 0)) for f in right] for g in left])) if j >= 0]


def edge_split(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """Edges (l, r) with whether both ends lie in one gold cluster."""
    side = lambda x: gold.select(F.col("id").alias(x), F.col("cluster").alias(f"{x}_cluster"))
    both = edges.join(side("l"), "l", "left").join(side("r"), "r", "left")
    return both.select("l", "r", F.coalesce(F.col("l_cluster") == F.col("r_cluster"), F.lit(False)).alias("correct"))


def slot_filling(cells: DataFrame, least: float = 0.9) -> DataFrame:
    """Per property how many values agree with the knowledge base. cells: property, score."""
    return cells.groupBy("property").agg(F.count("*").alias("n"), F.sum((F.col("score") > least).cast("int")).alias("correct"))


def dependency_scores(found: dict, gold: dict, closure) -> dict[str, float]:
    """Precision and recall of dependencies, one being right if the other side implies it."""
    from stitchwork.plans.dependencies import split

    share = lambda a, b: sum(x in closure(det, b) for det, x in split(a)) / max(1, len(split(a)))
    p, r = share(found, gold), share(gold, found)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def expanded(edges: DataFrame, provenance: DataFrame) -> DataFrame:
    """Edges between merged columns as edges between their sources. provenance: target, source. Sources of the same set of targets are
    of one class, and edges go between classes: each source has one, so that no pair comes twice and the pairs, which grow with the square
    of a class, need no shuffle."""
    own = provenance.where(F.col("target").isNotNull()).groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("class"))
    classes = own.select("class").distinct().select("class", F.explode("class").alias("target"))
    side = lambda x: classes.select(F.col("target").alias(x), F.col("class").alias(f"{x}_class"))
    met = edges.select("l", "r").distinct().join(side("l"), "l").join(side("r"), "r").select("l_class", F.col("r_class").alias("class")).distinct()
    left = own.select(F.col("source").alias("l"), F.col("class").alias("l_class")).join(met, "l_class").select("l", "class")
    return relational.all_pairs(left, own.select("class", F.col("source").alias("r")), ["class"]).select("l", "r")


def provenance_overlap(found: DataFrame, reference: DataFrame) -> DataFrame:
    """(f, g, weight): weight of the sources that a found and a reference item share. Both: id, source, weight."""
    g = reference.select(F.col("id").alias("g"), "source")
    return found.select(F.col("id").alias("f"), "source", "weight").join(g, "source").groupBy("f", "g").agg(F.sum("weight").alias("weight"))


def edges_to_gold(edges: DataFrame) -> DataFrame:
    """Gold clusters (id, cluster) from scored edges (l, r, score > 0)."""
    from stitchwork.operators.graph import components

    return components(edges.where("score > 0").select("l", "r")).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def weighted_pairwise(gold: DataFrame, edges: DataFrame) -> DataFrame:
    """M02, weighted: precision of edges, each counting the product of its ends' weights. gold: id, cluster, weight."""
    side = lambda x: gold.select(F.col("id").alias(x), F.col("cluster").alias(f"{x}_c"), F.col("weight").alias(f"{x}_w"))
    both = edges.join(side("l"), "l").join(side("r"), "r").withColumn("w", F.col("l_w") * F.col("r_w"))
    return both.agg(F.round(F.try_divide(F.sum(F.when(F.col("l_c") == F.col("r_c"), F.col("w")).otherwise(0)), F.sum("w")), 6).alias("precision"))
