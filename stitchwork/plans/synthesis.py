"""From the tables of one web site to normalised relations: context, union, dependencies, entities, decomposition."""

from __future__ import annotations

import re
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.operators import context, dependencies, graph, matching, relational, stitching
from stitchwork.plans import dependencies as algebra


@dataclass
class WebTable:
    """A table with what its page says about it. Column names are its headers."""

    url: str
    rows: DataFrame
    title: str | None = None
    heading: str | None = None

    def context(self) -> dict[str, str | None]:
        """Page title, heading, path segments and query parameters."""
        parts = urlsplit(self.url)
        out = {"page title": self.title, "table heading": self.heading}
        out |= {f"uri {i}": s.replace("-", " ") for i, s in enumerate(x for x in parts.path.split("/") if x)}
        seen: dict[str, int] = {}
        for p in filter(None, parts.query.split("&")):
            name, _, value = p.partition("=")
            name = re.sub(r"\W", "", name)
            seen[name] = seen.get(name, 0) + 1
            out[f"uri {name}" + (f"[{seen[name]}]" if seen[name] > 1 else "")] = unquote(value)
        return {k: v for k, v in out.items() if v is not None}


@dataclass
class Timings:
    """Nested run times."""

    lines: list[tuple[int, str, float]] = field(default_factory=list)
    depth: int = 0

    @contextmanager
    def step(self, name: str):
        began, at = time.time(), len(self.lines)
        self.lines.append((self.depth, name, 0.0))
        self.depth += 1
        try:
            yield
        finally:
            self.depth -= 1
            self.lines[at] = (self.depth, name, time.time() - began)


def union_with_context(tables: list[WebTable]) -> dict[str, DataFrame]:
    """Tables of one schema appended, with their context as columns; context that is the same for all of them is left out."""
    groups: dict[str, list[WebTable]] = {}
    for t in sorted(tables, key=lambda t: t.url):
        groups.setdefault("+".join(t.rows.columns), []).append(t)
    out = {}
    for schema, members in groups.items():
        contexts = [t.context() for t in members]
        names = sorted({n for c in contexts for n in c})
        names = [n for n in names if len(members) == 1 or len({c.get(n) for c in contexts}) > 1]
        parts = [t.rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in t.rows.columns), *(F.lit(c.get(n)).cast("string").alias(n) for n in names)) for t, c in zip(members, contexts, strict=True)]
        out[schema] = reduce(DataFrame.unionByName, parts).distinct()
    return out


def safe_names(columns: list[str]) -> dict[str, str]:
    """A name of letters, digits and _ for each column, all different."""
    out: dict[str, str] = {}
    for c in columns:
        name, n = re.sub(r"\W", "_", c), 1
        while name in out.values():
            n += 1
            name = f"{re.sub(r'[^0-9A-Za-z_]', '_', c)}_{n}"
        out[c] = name
    return out


def normalised(df: DataFrame, max_size: int | None = None, least: float = 1.0, timings: Timings | None = None, sources: dict[str, int] | None = None, fk: str | None = None) -> tuple[algebra.Fds, dict[str, DataFrame]]:
    """The dependencies of a table, and its relations in Boyce-Codd normal form, the best scored dependency first. sources:
    how many source tables a column has; fk: the column of the foreign key, without which no dependency counts (G18)."""
    timings = timings or Timings()
    safe = safe_names(df.columns)
    plain = df.select(*(F.col(f"`{c}`").alias(n) for c, n in safe.items()))
    with timings.step("dependencies"):
        fds = dependencies.discover(plain, plain.columns, max_size, least)
        if fk:
            fds = algebra.with_foreign_key(fds, safe[fk])
        cover = algebra.canonical_cover(fds)
    with timings.step("decomposition"):
        one = plain.agg(*(F.bool_and(F.col(c).try_cast("double").isNotNull()).alias(c) for c in plain.columns)).first()
        types = {c: "numeric" if one[c] else "string" for c in plain.columns}
        counts = {safe[c]: n for c, n in (sources or {}).items() if c in safe}
        score = lambda det, dep: (algebra.violation_score(det, dep, plain.columns, counts, types), sorted(det))
        relations = algebra.boyce_codd_normal_form(plain.columns, cover, score=score)
        return cover, dependencies.decomposed(plain, relations)


@dataclass
class Config:
    """What the whole workflow does: matcher (label, value or cosine) and its threshold, the filter for stitching (both, one or any), keys
    of entities (entity -> headers), and the bounds for tables, dependencies and relations."""

    matcher: str = "label"
    threshold: float = 0.2
    filter: str = "both"
    entities: dict[str, list[str]] = field(default_factory=dict)
    min_rows: int = 1
    max_size: int | None = None
    least: float = 1.0
    min_density: float = 0.0


@dataclass
class Site:
    """A site's union tables (table_id -> rows), their columns (table_id, ord, header, col_id, is_context), and what is made of them."""

    tables: dict[int, DataFrame]
    columns: DataFrame
    edges: DataFrame | None = None
    stitched: dict[int, DataFrame] = field(default_factory=dict)
    sources: dict[int, dict[str, int]] = field(default_factory=dict)
    entities: dict[str, DataFrame] = field(default_factory=dict)
    relations: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    timings: Timings = field(default_factory=Timings)


def site_of(tables: list[WebTable], config: Config) -> Site:
    """The union tables with enough rows, largest first, and the records of their columns."""
    spark = tables[0].rows.sparkSession
    unions = [relational.without_sparse_columns(df, 1e-9) for df in union_with_context(tables).values()]
    sized = sorted(((df.count(), i, df) for i, df in enumerate(unions)), key=lambda s: (-s[0], s[1]))
    kept = {k: df for k, (n, _, df) in enumerate(s for s in sized if s[0] >= config.min_rows)}
    rows = [(t, o, h, f"{t}~Col{o}") for t, df in kept.items() for o, h in enumerate(df.columns)]
    columns = spark.createDataFrame(rows, "table_id int, ord int, header string, col_id string")
    return Site(kept, columns.withColumn("is_context", context.is_context(F.col("header"))))


def site_cells(site: Site) -> DataFrame:
    """table_id, row_id, col_id, v of all tables."""
    parts = []
    for t, df in site.tables.items():
        values = F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns))
        row = df.select(F.xxhash64(values).cast("string").alias("row_id"), F.posexplode(values).alias("ord", "v")).where("v is not null")
        parts.append(row.select(F.lit(t).alias("table_id"), "row_id", F.concat(F.lit(f"{t}~Col"), F.col("ord").cast("string")).alias("col_id"), "v"))
    return graph._cut(reduce(DataFrame.unionByName, parts))


def match_site(site: Site, config: Config) -> Site:
    """A matcher's edges between columns that are no context, refined by headers and graph and closed; context columns of matched
    tables by their headers (I18, I19); then the filter for stitching (I12) on clusters of tables (H07)."""
    own = site.columns.where("not is_context")
    edges = matching.matched(site_cells(site), own, config.matcher, config.threshold)
    table = lambda x: site.columns.select(F.col("col_id").alias(x), F.col("table_id").alias(f"{x}_table"))
    placed = graph._cut(edges.join(table("l"), "l").join(table("r"), "r").where("l_table != r_table"))
    groups = stitching.entity_groups(placed, site.columns)
    more = matching.context_edges(site.columns.join(groups.withColumnRenamed("entity", "cluster"), "table_id"))
    both = matching.merged_context_edges(placed, more, site.columns).join(table("l"), "l").join(table("r"), "r")
    low = graph._cut(both.select(*(F.when(F.col("l_table") < F.col("r_table"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("l", "r"), ("r", "l"), ("l_table", "r_table"), ("r_table", "l_table")))).distinct())
    site.edges = graph._cut(matching.within_table_clusters(low, matching.fully_mapped(low, site.columns, config.filter)))
    return site


def stitch_site(site: Site) -> Site:
    """Tables of a cluster appended, their columns by clusters of matching ones under the header that most rows have."""
    clusters = {r["col_id"]: r["cluster"] for r in stitching.attribute_clusters(site.edges, site.columns).collect()}
    groups = {r["table_id"]: r["entity"] for r in stitching.entity_groups(site.edges, site.columns).collect()}
    sizes = {t: df.count() for t, df in site.tables.items()}
    heads = site.columns.collect()
    weight: dict[str, dict[str, int]] = {}
    for c in heads:
        by = weight.setdefault(clusters[c["col_id"]], {})
        by[c["header"]] = by.get(c["header"], 0) + sizes[c["table_id"]]
    for group in sorted(set(groups.values())):
        members = sorted(t for t, g in groups.items() if g == group)
        names: dict[str, str] = {}
        for cluster in dict.fromkeys(clusters[c["col_id"]] for c in heads if c["table_id"] in members):
            best = max(weight[cluster], key=lambda h: (weight[cluster][h], h))
            names[cluster] = best if best not in names.values() else f"{best} ({cluster})"
        mapping = {str(t): {c["header"]: names[clusters[c["col_id"]]] for c in heads if c["table_id"] == t} for t in members}
        site.stitched[group] = stitching.stitched({str(t): site.tables[t] for t in members}, mapping)
        site.sources[group] = {n: sum(n in m.values() for m in mapping.values()) for n in names.values()}
    return site


def normalise_site(site: Site, config: Config) -> Site:
    """Entities by their keys, foreign keys in the tables that have all of a key's columns, dependencies,
    decomposition; fragments without the foreign key and sparse ones go, where a table has one."""
    for entity, key in sorted(config.entities.items()):
        holders = [df for df in site.stitched.values() if set(key) <= set(df.columns)]
        if holders:
            site.entities[entity] = stitching.entity_table(holders, key)
    for group, df in site.stitched.items():
        name = next((e for e, key in sorted(config.entities.items()) if e in site.entities and set(key) <= set(df.columns)), None)
        with site.timings.step(f"table {group}"):
            if name:
                df = stitching.with_foreign_key(df, site.entities[name], config.entities[name]).withColumnRenamed("fk", "FK")
            _, relations = normalised(df, config.max_size, config.least, site.timings, site.sources[group], "FK" if name else None)
            if name:
                total = site.entities[name].count()
                relations = {k: r for k, r in relations.items() if "FK" in r.columns and r.select("FK").distinct().count() >= config.min_density * total}
        site.relations[f"{name or 'table'} {group}"] = relations
    return site


def normalise_web_tables(tables: list[WebTable], config: Config | None = None) -> Site:
    """The whole workflow: union tables, matching, stitching, entities, foreign keys, dependencies and relations."""
    config = config or Config()
    site = site_of(tables, config)
    for name, step in (("matching", lambda: match_site(site, config)), ("stitching", lambda: stitch_site(site)), ("normalisation", lambda: normalise_site(site, config))):
        with site.timings.step(name):
            step()
    return site


def synthesised(tables: list[WebTable], min_rows: int = 1, max_size: int | None = None, least: float = 1.0) -> dict[str, dict[str, DataFrame]]:
    """All steps: the relations of each union table with enough rows."""
    timings, out = Timings(), {}
    with timings.step("union"):
        unions = union_with_context(tables)
    for schema, df in unions.items():
        filled = relational.without_sparse_columns(df, 1e-9)
        if filled.count() >= min_rows:
            with timings.step(schema):
                out[schema] = normalised(filled, max_size, least, timings)[1]
    return out
