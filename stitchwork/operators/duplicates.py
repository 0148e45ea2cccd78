"""Duplicate records within and across tables, and what is fused from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.functions import similarity, text
from stitchwork.operators import graph, matching, ranking


def within_table(df: DataFrame, id_col: str, keys: list[list[str]]) -> DataFrame:
    """(l, r): records that agree in all columns of some candidate key, each with the smallest id of its group: as many edges as
    records, which join what all pairs would. A null agrees with nothing."""
    out = []
    for key in keys:
        filled = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key)))
        first = filled.groupBy(*key).agg(F.min(id_col).alias("l"), F.count("*").alias("__n")).where("__n > 1")
        out.append(filled.select(*key, F.col(id_col).alias("r")).join(first, key).where("l != r").select("l", "r"))
    return reduce(DataFrame.unionByName, out).distinct()


def across_tables(left: DataFrame, right: DataFrame, id_col: str, label: str, kinds: dict[str, str], threshold: float = 0.6) -> DataFrame:
    """(l, r, score) of records with equal labels whose mean similarity over the columns, each by its kind, reaches the threshold, one
    to one, best first. kinds: column -> numeric, date or string; where both sides are null a column says 0."""
    own = lambda d, x: d.select(F.col(label).cast("string").alias("label"), F.col(id_col).alias(x), *(F.col(c).cast("string").alias(f"{x}_{c}") for c in kinds))
    both = own(left, "l").join(own(right, "r"), "label")
    mean = sum((F.coalesce(matching.typed_vote(F.col(f"l_{c}"), F.col(f"r_{c}"), k), F.lit(0.0)) for c, k in kinds.items()), F.lit(0.0)) / len(kinds)
    scored = both.withColumn("score", F.round(mean, 6)).where(F.col("score") >= threshold).select("label", "l", "r", "score")
    return ranking.greedy_one_to_one(scored, ["label"]).select("l", "r", "score")


def fused(entities: DataFrame, edges: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(cluster, sets of the columns' values, n) of entities joined by edges, single ones among them."""
    found = graph.components(edges)
    placed = entities.join(found, F.col(id_col) == F.col("node"), "left").withColumn("cluster", F.coalesce("component", F.col(id_col)))
    return placed.groupBy("cluster").agg(*(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns), F.count("*").alias("n"))


def deduplicated(df: DataFrame, id_col: str, keys: list[list[str]], columns: list[str], remove_violations: bool = True) -> DataFrame:
    """Duplicates by candidate keys merged: each column's first value by id that is not null; a group with two values in a column goes,
    if violations are removed; rows without any complete key go."""
    edges = within_table(df, id_col, keys)
    found = graph.components(edges)
    placed = df.join(found, F.col(id_col) == F.col("node"), "left").withColumn("entity", F.coalesce("component", F.col(id_col)))
    value = lambda c: F.struct(F.col(id_col).alias("i"), F.col(c).alias("v"))
    merged = placed.groupBy("entity").agg(
        *(F.min(F.when(F.col(c).isNotNull(), value(c))).getField("v").alias(c) for c in columns),
        *(F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"__{c}") for c in columns), F.count("*").alias("n_rows"),
    )
    if remove_violations:
        merged = merged.where(reduce(lambda a, b: a & b, (~F.col(f"__{c}") for c in columns)))
    from stitchwork.operators import relational

    return relational.enforce_keys(merged, keys).select("entity", *columns, "n_rows")


def edit_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, jaccard, containment, edits) of given pairs of labels. left, right: id, label."""
    own = lambda d, x: d.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"))
    both = pairs.select("l", "r").join(own(left, "l"), "l").join(own(right, "r"), "r")
    a, b = text.tokens(F.col("l_label")), text.tokens(F.col("r_label"))
    six = lambda c: F.round(c, 6)
    return both.select("l", "r", six(similarity.token_jaccard(a, b)).alias("jaccard"), six(similarity.token_containment(a, b)).alias("containment"), six(similarity.edit_similarity(F.col("l_label"), F.col("r_label"))).alias("edits"))
