"""Choosing columns, edges, tuples and tables by what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.operators import relational


def without_keys(df: DataFrame) -> DataFrame:
    """Without primary and foreign key columns, whatever their case."""
    return df.drop(*(c for c in df.columns if c.lower() in ("pk", "fk")))


def selected_tuples(tuples: DataFrame, wanted: DataFrame) -> DataFrame:
    """C14: tuples (table, attribute, ...) that an assignment asks for, with the name of its output. wanted: table, attribute, output."""
    return relational.described(tuples, wanted, ["table", "attribute"])


def write_selected(selected: DataFrame, path: str) -> None:
    """C14: one folder for each output."""
    selected.write.mode("overwrite").partitionBy("output").parquet(path)


def dense_edges(edges: DataFrame, profile: DataFrame, least: float = 1.0) -> DataFrame:
    """Edges whose left column is dense enough. profile: column, density."""
    return edges.join(profile.where(F.col("density") >= least).select(F.col("column").alias("l")), "l", "left_semi")


def above(edges: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """Edges whose score reaches the threshold, or exceeds it if strict."""
    return edges.where(F.col("score") > least if strict else F.col("score") >= least)


def reference_scores(references: DataFrame, matches: DataFrame, scores: DataFrame) -> DataFrame:
    """(table, match, score): every reference table, those without a match with 0. matches: table, match; scores: match, score."""
    both = references.select("table").join(matches, "table", "left").join(scores, "match", "left")
    return both.select("table", "match", F.coalesce("score", F.lit(0.0)).alias("score"))


def weighted_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores times the weight of the right end. weights: id, weight."""
    return edges.join(weights.select(F.col("id").alias("r"), "weight"), "r").withColumn("score", F.col("score") * F.col("weight")).drop("weight")


def labelled_records(records: DataFrame, label_columns: DataFrame) -> DataFrame:
    """Records (table_id, row_id, col_id, v) with their table's label value. label_columns: table_id, label."""
    named = label_columns.select("table_id", F.col("label").alias("col_id"))
    return relational.described(records, named, ["table_id", "col_id"]).select("table_id", "row_id", F.col("v").alias("label"))


def normalised_scores(edges: DataFrame, bias: float = 1.0) -> DataFrame:
    """(l, r, table, score): each score over the table's largest one plus a bias for the number of matched cells. edges: l, r, table, score, cells."""
    top = edges.groupBy("table").agg(F.max("score").alias("top"), F.max("cells").alias("most"))
    part = F.try_divide("score", F.col("top")) * F.try_divide(F.col("cells") + bias, F.col("most") + bias)
    return edges.join(top, "table").select("l", "r", "table", F.round(part, 6).alias("score"))


def causes(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Nested evidence (l, r, cause_l, cause_r) that lies in just the two sources of its pair. sources: id, source."""
    side = lambda x: sources.select(F.col("id").alias(x), F.col("source").alias(f"{x}_s"))
    named = edges
    for x in ("l", "r", "cause_l", "cause_r"):
        named = named.join(side(x), x)
    pair = lambda a, b: F.array_sort(F.array(a, b))
    return named.where(pair("l_s", "r_s") == pair("cause_l_s", "cause_r_s")).select("l", "r", "cause_l", "cause_r")


def complete_tables(mapped: DataFrame, properties: DataFrame) -> DataFrame:
    """Tables all of whose class's properties are mapped. mapped: table, class, property; properties: class, property."""
    need = properties.groupBy("class").agg(F.countDistinct("property").alias("need"))
    have = mapped.join(properties, ["class", "property"], "left_semi").groupBy("table", "class").agg(F.countDistinct("property").alias("n"))
    return have.join(need, "class").where("n = need").select("table", "class")


def relation_edges(columns: DataFrame, tokens: DataFrame, least: float = 0.5) -> DataFrame:
    """Columns of relations of one class by the Jaccard of their tokens. columns: col_id, class; tokens: owner, token."""
    from stitchwork.operators import vectors

    keyed = tokens.join(columns.select(F.col("col_id").alias("owner"), "class"), "owner").select("owner", F.concat_ws("|", "class", "token").alias("token"))
    v = vectors.vectors(keyed, "binary")
    return vectors.jaccard(v, v, least).where("l < r")


def of_tables(tables: DataFrame, edges: DataFrame, columns: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, columns and keys (table_id, cols) all of whose columns lie in the tables (table_id)."""
    own = columns.join(tables.select("table_id"), "table_id", "left_semi")
    ids = own.select("col_id")
    end = lambda x: ids.select(F.col("col_id").alias(x))
    return edges.join(end("l"), "l", "left_semi").join(end("r"), "r", "left_semi"), own, keys.join(tables.select("table_id"), "table_id", "left_semi")


def by_subject(columns: DataFrame, subjects: DataFrame) -> DataFrame:
    """(table_id, col_id): each table's entity by its subject column alone. subjects: table_id, col_id."""
    return columns.join(subjects.select("table_id", "col_id"), ["table_id", "col_id"], "left_semi").select("table_id", "col_id")


def renamed_by_sources(columns: DataFrame, names: DataFrame) -> DataFrame:
    """(col_id, name): the attribute with which a column shares most of its sources. columns: col_id, source; names: name, source."""
    common = columns.join(names, "source").groupBy("col_id", "name").agg(F.count("*").alias("n"))
    return common.groupBy("col_id").agg(F.max_by("name", F.struct("n", "name")).alias("name"))
