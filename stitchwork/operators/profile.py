"""Profiles of columns, tables and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, density, uniqueness) in one pass; null counts as a value of its own."""
    aggs = []
    for c in columns:
        aggs += [(F.count(c) / F.count("*")).alias(f"d_{c}"), ((F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))) / F.count("*")).alias(f"u_{c}")]
    row = df.agg(*aggs)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.round(f"d_{c}", 6).alias("density"), F.round(f"u_{c}", 6).alias("uniqueness")) for c in columns))
    return row.select(F.inline(pairs))


def set_uniqueness(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(columns, uniqueness) of column sets; nulls are equal."""
    out = None
    for s in sets:
        one = df.groupBy(*s).agg(F.count("*").alias("n")).agg(F.round(F.count("*") / F.sum("n"), 6).alias("uniqueness")).select(F.lit("+".join(s)).alias("columns"), "uniqueness")
        out = one if out is None else out.unionByName(one)
    return out


def conflict_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows in groups of more than one, without rows that are null in all columns."""
    filled = df.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull())
    groups = filled.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("conflict_rate"), F.round(F.count("*") / F.sum("n"), 6).alias("uniqueness"))


def blocking_keys(profile: DataFrame, least: float = 0.1) -> DataFrame:
    """Columns with uniqueness of at least the bound, else the most unique one."""
    some = F.max((F.col("uniqueness") >= least).cast("int")).over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("uniqueness"), "column"))
    return profile.withColumn("some", some).withColumn("rank", rank).where(((F.col("some") == 1) & (F.col("uniqueness") >= least)) | ((F.col("some") == 0) & (F.col("rank") == 1))).select("column", "uniqueness")


def size_weights(sizes: DataFrame) -> DataFrame:
    """Class, weight = 1 - size over the largest size. sizes: class, n."""
    top = sizes.agg(F.max("n")).first()[0]
    return sizes.select("class", F.round(1 - F.col("n") / F.lit(top), 6).alias("weight"))


def similarity_histogram(scores: DataFrame, column: str) -> DataFrame:
    """(bin, n) with bins 0.0, 0.1, ... 1.0."""
    return scores.groupBy(F.round(column, 1).alias("bin")).agg(F.count("*").alias("n"))


def cardinality(relation: DataFrame, fk: str) -> DataFrame:
    """Tuples, distinct foreign keys and tuples per key."""
    groups = relation.groupBy(fk).agg(F.count("*").alias("n")).where(F.col(fk).isNotNull())
    return groups.agg(F.sum("n").alias("n_tuples"), F.count("*").alias("n_keys"), F.round(F.sum("n") / F.count("*"), 6).alias("per_key"))


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Of each group the value with the largest sum of weights, the smallest of equals."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    first = Window.partitionBy(*by).orderBy(F.desc("w"), value)
    return sums.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def sample(df: DataFrame, n: int, id_col: str, seed: int = 1) -> DataFrame:
    """So many rows, the same ones whenever the ids are the same."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def votes(edges: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Sum of positive votes over the left table's rows, of equal types. edges: l, r, l_table, l_type, r_type, score; sizes: l_table, n_rows."""
    summed = edges.where("score > 0 and l_type = r_type").groupBy("l", "r", "l_table").agg(F.sum("score").alias("score"))
    return summed.join(sizes, "l_table").select("l", "r", F.round(F.col("score") / F.col("n_rows"), 6).alias("score")).where(F.col("score") >= least)


def class_argmax(scores: DataFrame, least: int = 1, sizes: DataFrame | None = None, ratio: float = 0.0) -> DataFrame:
    """Per table the class with the largest sum of scores, among those with enough matches, and with sizes (table, n_entities)
    enough for the table's size. scores: table, class, score."""
    sums = scores.groupBy("table", "class").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= least)
    if sizes is not None:
        sums = sums.join(sizes, "table").where(F.col("n") >= ratio * F.col("n_entities")).drop("n_entities")
    first = Window.partitionBy("table").orderBy(F.desc("score"), "class")
    return sums.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Of each group its values, how often and their share."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(total, by).select(*by, value, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def table_statistics(cells: DataFrame) -> DataFrame:
    """(table_id, n_rows, n_columns, n_cells) of cells (table_id, row_id, col_id, v)."""
    return cells.groupBy("table_id").agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("col_id").alias("n_columns"), F.count("v").alias("n_cells"))


def dependency_statistics(dependencies: DataFrame) -> DataFrame:
    """(table_id, n_dependencies, n_determinant, n_dependants) of dependencies (table_id, det, dep): how many, mean sizes of both sides."""
    mean = lambda c: F.round(F.avg(F.size(c)), 6)
    return dependencies.groupBy("table_id").agg(F.count("*").alias("n_dependencies"), mean("det").alias("n_determinant"), mean("dep").alias("n_dependants"))


def dependant_pairs(dependencies: DataFrame) -> DataFrame:
    """(l, r, n): attributes that depend on the same determinants, in how many dependencies (table_id, det, dep)."""
    one = dependencies.select("table_id", "det", F.explode("dep").alias("l"))
    other = dependencies.select(F.col("table_id").alias("t"), F.col("det").alias("d"), F.explode("dep").alias("r"))
    return one.join(other, (F.col("table_id") == F.col("t")) & (F.col("det") == F.col("d")) & (F.col("l") < F.col("r"))).groupBy("l", "r").agg(F.count("*").alias("n"))


def fusion_statistics(clusters: DataFrame) -> DataFrame:
    """(size, n) of fused clusters (id, cluster): how many have so many members."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def numbered(items: DataFrame, order: list) -> DataFrame:
    """items with an id from 0 in an order (tables by falling size, dependencies by their text)."""
    from stitchwork.operators.ranking import row_numbers

    return row_numbers(items, order, "id")
