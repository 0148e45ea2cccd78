"""Filters, keys, deduplication policies and joins of relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each side in one cell of a grid, and pairs of one key from which on its rows are dealt over a grid.
CELL_ROWS, GRID_PAIRS = 1024, 4 * 1024 * 1024
#: Rows of metadata up to which they are broadcast.
METADATA_ROWS = 100_000


def present(c: str) -> Column:
    """Neither null nor blank."""
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")


def has_content(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in any of the columns."""
    return df.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull())


def enforce_keys(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """A row stays if at least one candidate key is complete in it."""
    return df.where(reduce(Column.__or__, (reduce(Column.__and__, map(present, key)) for key in keys)))


def without_sparse_columns(df: DataFrame, min_density: float) -> DataFrame:
    """Columns whose share of non-null rows reaches min_density; one aggregation finds them."""
    row = df.agg(F.count("*").alias("__n"), *(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if row["__n"] and row[c] >= min_density * row["__n"]))


def large_groups(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups of at least so many."""
    big = df.groupBy(*by).count().where(F.col("count") >= least).drop("count")
    return df.join(big, by, "left_semi")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """C09 KeepFirst: of each key the first row in the order; nulls in keys are equal."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def replace_nulls(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """C09 ReplaceNULLs: one row for each key whose rows have at most one value in each column, with these values; partial sums only."""
    fills = [F.min(c).alias(c) for c in columns]
    conflict = [(F.min(c) != F.max(c)).alias(f"__{c}") for c in columns]
    merged = df.groupBy(*key).agg(*fills, *conflict)
    fine = reduce(Column.__and__, (~F.coalesce(F.col(f"__{c}"), F.lit(False)) for c in columns))
    return merged.where(fine).select(*key, *columns)


def create_set(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """C09 CreateSet: one row for each key, with the sorted distinct values of each column."""
    return df.groupBy(*key).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def conflicts(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """C09 ReturnConflicts: rows whose key has more than one value in a column."""
    both = df.groupBy(*key).agg(*((F.min(c) != F.max(c)).alias(f"__{c}") for c in columns))
    bad = both.where(reduce(Column.__or__, (F.coalesce(F.col(f"__{c}"), F.lit(False)) for c in columns))).select(*key)
    return df.join(bad, key, "left_semi")


def keep_both(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """C09 KeepBoth: rows differing in payload stay apart, equal ones become one."""
    return df.select(*key, *columns).distinct()


def distinct_but(df: DataFrame, ignored: str) -> DataFrame:
    """C11: rows equal in all columns but one become that with its smallest value."""
    rest = [c for c in df.columns if c != ignored]
    return df.groupBy(*rest).agg(F.min(ignored).alias(ignored)).select(*df.columns)


def join_on(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of the same names; of other equal names the left one stays."""
    return left.join(right.select(*on, *(c for c in right.columns if c not in left.columns)), on, "inner")


def entity_join(entities: DataFrame, relation: DataFrame, pk: str, fk: str) -> DataFrame:
    """A relation with its entities' attributes, without the keys."""
    return relation.join(entities, F.col(fk) == F.col(pk)).drop(pk, fk)


def missing_edges(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (l, r) that are not known yet."""
    return candidates.join(known, ["l", "r"], "left_anti")


def disjoint_provenance(edges: DataFrame, provenance: DataFrame, invert: bool = False) -> DataFrame:
    """Edges (l, r) whose ends share no source (or do, inverted). provenance: col_id, sources."""
    side = lambda x: provenance.select(F.col("col_id").alias(x), F.col("sources").alias(f"{x}_sources"))
    both = edges.join(side("l"), "l").join(side("r"), "r")
    overlap = F.arrays_overlap("l_sources", "r_sources")
    return both.where(overlap if invert else ~overlap).drop("l_sources", "r_sources")


def same_class(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (l, r) whose ends have the same class. classes: id, class."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("class").alias(f"{x}_class"))
    return edges.join(side("l"), "l").join(side("r"), "r").where("l_class = r_class").drop("l_class", "r_class")


def dense_relations(relation: DataFrame, fk: str, columns: list[str], entities: int, least: float) -> DataFrame:
    """C17: of a relation's columns the share of entities that have a value, for those reaching the least."""
    n = relation.agg(*(F.countDistinct(F.when(F.col(c).isNotNull(), F.col(fk))).alias(c) for c in columns))
    rows = n.unpivot([], columns, "column", "n_entities")
    return rows.withColumn("density", F.round(F.col("n_entities") / entities, 6)).where(F.col("density") >= least)


def fill_cover(tables: dict[str, set], wanted: set) -> list[str]:
    """Excluded tables that come back, each time the one with most attributes still missing."""
    missing, out = set(wanted), []
    while missing:
        best = max(sorted(tables), key=lambda t: len(tables[t] & missing), default=None)
        if best is None or not tables[best] & missing:
            break
        out.append(best)
        missing -= tables[best]
    return out


def all_pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on columns of both sides, for keys of many pairs: the rows of a key of over GRID_PAIRS pairs are dealt over a grid, by
    their hash, and copied once for each cell that they meet, so that a few keys with most of the rows are work for all tasks. Rows of
    other keys are not copied. Keys for a grid are at most one for each 4096 rows, and so are broadcast."""
    filled = reduce(Column.__and__, (F.col(c).isNotNull() for c in on))
    left, right = left.where(filled), right.where(filled)
    count = lambda d, name: d.groupBy(*on).agg(F.count("*").alias(name))
    many = count(left, "__a").join(count(right, "__b"), on).where(F.col("__a") * F.col("__b").cast("double") > GRID_PAIRS)
    cells = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int")
    grid = F.broadcast(many.select(*on, cells("__a").alias("__rows"), cells("__b").alias("__columns")))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(d: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        place = F.pmod(F.xxhash64(*(d[f"`{c}`"] for c in d.columns)), n(F.col(n_own))).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), n(F.col(n_other)) - 1)).alias(other)
        return d.join(grid, on, "left").select(*(d[f"`{c}`"] for c in d.columns), place, copies).repartition(parts, *on, "__row", "__column")

    a, b = dealt(left, "__row", "__rows", "__column", "__columns"), dealt(right, "__column", "__columns", "__row", "__rows")
    return a.join(b.hint("merge"), [*on, "__row", "__column"]).drop("__row", "__column")


def described(rows: DataFrame, metadata: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of rows with metadata (labels, types, assignments), whose few keys most rows can have: broadcast once a count shows that
    it has up to METADATA_ROWS rows, so that rows stay where they are; more of it meets the rows on a grid (all_pairs)."""
    if metadata.limit(METADATA_ROWS + 1).count() <= METADATA_ROWS:
        return rows.join(F.broadcast(metadata), on)
    return all_pairs(rows, metadata, on)
