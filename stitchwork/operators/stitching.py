"""Union tables, stitched tables, entities, foreign keys, fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.operators import graph, relational


def union_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with the same schema string appended, with the name of the table that each row came from."""
    groups: dict[str, list[DataFrame]] = {}
    for name in sorted(tables):
        df = tables[name]
        groups.setdefault("+".join(df.columns), []).append(df.withColumn("source_table", F.lit(name)))
    return {schema: reduce(DataFrame.unionByName, dfs) for schema, dfs in groups.items()}


def stitched(tables: dict[str, DataFrame], mapping: dict[str, dict[str, str]], key: list[str] | None = None) -> DataFrame:
    """Tables brought to common columns by a mapping (table: column: name), appended, and made one row for each key by
    ReplaceNULLs (without a key: distinct rows). Columns that a table lacks are null."""
    names = sorted({n for m in mapping.values() for n in m.values()})
    parts = []
    for table in sorted(tables):
        own = {n: c for c, n in mapping[table].items()}
        parts.append(tables[table].select(*((F.col(own[n]) if n in own else F.lit(None)).cast("string").alias(n) for n in names)))
    rows = reduce(DataFrame.unionByName, parts)
    return relational.replace_nulls(rows, key, [n for n in names if n not in key]) if key else rows.distinct()


def majority_headers(provenance: DataFrame) -> DataFrame:
    """(target, header): the most frequent header of a merged column's sources, the smallest of equals. target, header, n."""
    sums = provenance.where("header is not null").groupBy("target", "header").agg(F.sum("n").alias("w"))
    return sums.groupBy("target").agg(F.max(F.struct("w", F.col("header"))).alias("best")).select("target", "best.header")


def attribute_clusters(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(col_id, cluster): components of matching columns; a column without matches is its own."""
    found = graph.components(edges.select("l", "r"))
    return columns.select("col_id").join(found, F.col("col_id") == F.col("node"), "left").select("col_id", F.coalesce("component", "col_id").alias("cluster"))


def entity_table(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Distinct key values over all tables, with a primary key that depends on the values alone."""
    rows = reduce(DataFrame.unionByName, (p.select(*(F.col(c).cast("string").alias(c) for c in key)) for p in parts)).distinct()
    return relational.enforce_keys(rows, [key]).withColumn("pk", F.sha2(F.concat_ws("\x1f", *key), 256).substr(1, 16))


def with_foreign_key(df: DataFrame, entities: DataFrame, key: list[str], pk: str = "pk") -> DataFrame:
    """Rows with their entity's key in place of its attributes; rows without an entity go."""
    keys = entities.select(*key, F.col(pk).alias("fk"))
    return df.withColumns({c: F.col(c).cast("string") for c in key}).join(keys, key).drop(*key)


def merged_entities(df: DataFrame, edges: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Duplicates (edges l, r of ids) merged: one row for each component with the smallest id and non-null values filled in."""
    found = graph.components(edges)
    placed = df.join(found, F.col(id_col) == F.col("node"), "left").withColumn("entity", F.coalesce("component", F.col(id_col)))
    # the first non-null value by id: partial sums only, whatever the size of a component
    fill = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(id_col).alias("i"), F.col(c).alias("v")))).getField("v").alias(c) for c in columns]
    return placed.groupBy("entity").agg(*fill, F.count("*").alias("n_rows"))


def rewritten_keys(relation: DataFrame, mapping: DataFrame, fk: str) -> DataFrame:
    """Foreign keys replaced by those of the fused entities. mapping: old, new."""
    return relation.join(mapping, F.col(fk) == F.col("old"), "left").withColumn(fk, F.coalesce("new", F.col(fk))).drop("old", "new")


def tuple_listing(df: DataFrame, table: str, key: list[str], columns: list[str]) -> DataFrame:
    """(table, key, attribute, value) for each non-null cell that is no key; the key as JSON in the key's order."""
    named = df.select(F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in key))).alias("key"), *(F.col(c).cast("string").alias(c) for c in columns))
    return named.unpivot(["key"], columns, "attribute", "value").where("value is not null").select(F.lit(table).alias("table"), "key", "attribute", "value")


def tuples_to_wide(tuples: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """A listing back in wide form."""
    keyed = tuples.select(F.from_json("key", ", ".join(f"{k} string" for k in key)).alias("k"), "attribute", "value").select("k.*", "attribute", "value")
    return keyed.groupBy(*key).agg(*(F.min(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in attributes))


def subject_column(df: DataFrame, columns: list[str], least: float = 0.001) -> str | None:
    """Of the text columns the most unique one, the leftmost of equals."""
    text = [c for c in columns if dict(df.dtypes)[c] == "string"]
    if not text:
        return None
    row = df.agg(F.count("*").alias("__n"), *(F.countDistinct(c).alias(c) for c in text)).first()
    best = max(text, key=lambda c: (row[c], -text.index(c)))
    return best if row["__n"] and row[best] / row["__n"] >= least else None


def inferred_types(cells: DataFrame) -> DataFrame:
    """(col_id, type): the type that most of a column's values can be cast to, from the strictest on; string unless most fit one."""
    v = F.trim("v")
    kinds = {"boolean": F.lower(v).isin("true", "false", "yes", "no"), "numeric": v.try_cast("double").isNotNull(), "date": v.try_cast("timestamp").isNotNull() & v.rlike(r"\D")}
    sums = cells.where("v is not null").groupBy("col_id").agg(F.count("*").alias("n"), *(F.sum(c.cast("int")).alias(k) for k, c in kinds.items()))
    kind = reduce(lambda rest, k: F.when(2 * F.col(k) > F.col("n"), k).otherwise(rest), reversed(kinds), F.lit("string"))
    return sums.select("col_id", kind.alias("type"))


def repaired_header(cells: DataFrame) -> DataFrame:
    """(table_id, col_id, header) from the first row that has any value, for tables without headers. cells: table_id, row_id, col_id, v."""
    first = cells.where("v is not null").groupBy("table_id").agg(F.min("row_id").alias("first"))
    return cells.join(first, "table_id").where("row_id = first and v is not null").select("table_id", "col_id", F.col("v").alias("header"))


def stacked_tables(columns: DataFrame) -> DataFrame:
    """Tables whose headers are one list repeated side by side. columns: table_id, ord, header."""
    w = Window.partitionBy("table_id")
    n, times = F.count("*").over(w), F.count("*").over(Window.partitionBy("table_id", "header"))
    counted = columns.withColumns({"n": n, "times": times, "first": F.min("ord").over(Window.partitionBy("table_id", "header"))}).withColumn("places", F.min("times").over(w))
    period = F.col("n") / F.col("places")
    fits = (F.col("places") > 1) & (F.col("times") == F.col("places")) & ((F.col("ord") - F.col("first")) % period == 0)
    return counted.groupBy("table_id").agg(F.bool_and(fits).alias("stacked")).where("stacked").select("table_id")


def schema_strings(columns: DataFrame) -> DataFrame:
    """(table_id, schema, own_schema): headers in order, with and without context columns. columns: table_id, ord, header, is_context."""
    listed = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("header", F.lit("")).alias("h"), "is_context")))
    rows = columns.groupBy("table_id").agg(listed.alias("c"))
    return rows.select("table_id", F.expr("array_join(transform(c, x -> x.h), '+')").alias("schema"), F.expr("array_join(transform(filter(c, x -> not x.is_context), x -> x.h), '+')").alias("own_schema"))


def clustered_union(tables: dict[str, DataFrame], clusters: dict[str, str]) -> dict[tuple[str, str], DataFrame]:
    """Union tables within each cluster of tables, distinct rows only."""
    out = {}
    for cluster in sorted(set(clusters.values())):
        members = {n: df for n, df in tables.items() if clusters[n] == cluster}
        out.update({(cluster, schema): df.distinct() for schema, df in union_tables(members).items()})
    return out


def clustered_rows(rows: DataFrame, schemas: DataFrame, clusters: DataFrame) -> DataFrame:
    """L02 in one plan: (cluster, schema, row, n_tables): distinct rows of the union tables, one for each cluster of tables and schema, and
    how many tables a row came from. rows: table_id, row; schemas: table_id, schema; clusters: table_id, cluster."""
    placed = rows.join(schemas.select("table_id", "schema"), "table_id").join(clusters.select("table_id", "cluster"), "table_id")
    return placed.groupBy("cluster", "schema", "row").agg(F.countDistinct("table_id").alias("n_tables"))


def entity_groups(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, entity): tables of a component of matching columns describe one entity type. columns: table_id, col_id."""
    side = lambda x: columns.select(F.col("col_id").alias(x), F.col("table_id").alias(f"{x}_t"))
    between = edges.select("l", "r").join(side("l"), "l").join(side("r"), "r").select(F.col("l_t").alias("l"), F.col("r_t").alias("r"))
    found = graph.components(between)
    return columns.select("table_id").distinct().join(found, F.col("table_id") == F.col("node"), "left").select("table_id", F.coalesce("component", "table_id").alias("entity"))


def annotated(rows: DataFrame, links: DataFrame, kb: DataFrame, properties: list[str]) -> DataFrame:
    """Rows (id, ...) with columns of the entities they are linked to. links: l, r; kb: id, property, value."""
    wide = kb.where(F.col("property").isin(properties)).groupBy(F.col("id").alias("r")).agg(*(F.min(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in properties))
    return rows.join(links.select(F.col("l").alias("id"), "r"), "id", "left").join(wide, "r", "left").drop("r")


def attribute_table_clusters(tables: DataFrame) -> DataFrame:
    """(pair, n): pairs of attribute clusters that tables share, most tables first. tables: table_id, cluster."""
    t = tables.distinct()
    other = t.select(F.col("table_id").alias("t"), F.col("cluster").alias("c"))
    pairs = t.join(other, (F.col("table_id") == F.col("t")) & (F.col("cluster") < F.col("c")))
    return pairs.groupBy(F.concat_ws("+", "cluster", "c").alias("pair")).agg(F.count("*").alias("n"))


def translated_rows(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, target): each id's last target. mapping: id, target, pos."""
    return ids.join(mapping, "id").groupBy("id").agg(F.max_by("target", "pos").alias("target"))
