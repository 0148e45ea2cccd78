"""Context columns of pages: what title, heading and URL say about a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers and header prefixes of context columns.
STATIC = ("page title", "table heading")
PREFIXES = ("Entity Context", "Context # of ", "Disambiguation of ")


def uri_path_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, pos, header, value) for each path segment, with - as a space."""
    path = F.regexp_extract(F.col(url_col), r"^[a-z]+://[^/?#]+/([^?#]*)", 1)
    parts = pages.where(path != "").select(id_col, F.posexplode(F.split(path, "/")).alias("pos", "segment"))
    return parts.where("segment != ''").select(id_col, "pos", F.concat(F.lit("uri "), F.col("pos").cast("string")).alias("header"), F.translate("segment", "-", " ").alias("value"))


def uri_query_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, header, value) for each query parameter; the k-th of a name is called name[k]."""
    query = F.regexp_extract(F.col(url_col), r"\?([^#]*)", 1)
    parts = pages.where(query != "").select(id_col, F.posexplode(F.split(query, "&")).alias("pos", "part"))
    name = F.regexp_replace(F.split("part", "=")[0], r"\W", "")
    value = F.try_url_decode(F.get(F.split("part", "="), F.lit(1)))
    k = F.row_number().over(Window.partitionBy(id_col, "name").orderBy("pos"))
    named = parts.select(id_col, "pos", name.alias("name"), F.coalesce(value, F.lit("")).alias("value")).where("name != ''").withColumn("k", k)
    header = F.concat(F.lit("uri "), "name", F.when(F.col("k") > 1, F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]"))).otherwise(""))
    return named.select(id_col, header.alias("header"), "value")


def context_wide(pages: DataFrame, depth: int, title: Column, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each table with its title and first path segments as columns."""
    path = F.split(F.regexp_extract(F.col(url_col), r"^[a-z]+://[^/?#]+/([^?#]*)", 1), "/")
    segments = {f"uri_{i}": F.nullif(F.translate(F.coalesce(F.get(path, F.lit(i)), F.lit("")), "-", " "), F.lit("")) for i in range(depth)}
    return pages.select(id_col, title.alias("page_title"), *(c.alias(n) for n, c in segments.items()))


def context_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The context headers of a corpus and how many tables have each, title and heading first."""
    found = uri_path_parts(pages, id_col, url_col).select(id_col, "header").unionByName(uri_query_parts(pages, id_col, url_col).select(id_col, "header"))
    return found.groupBy("header").agg(F.countDistinct(id_col).alias("n_tables"))


def is_static_context(header: Column) -> Column:
    """Page title and table heading."""
    return F.coalesce(header.isin(*STATIC), F.lit(False))


def is_uri_context(header: Column) -> Column:
    """Path segments and query parameters."""
    return F.coalesce(header.rlike(r"^uri \w+$"), F.lit(False))


def is_union_context(header: Column) -> Column:
    """What the union of a site's tables adds."""
    return is_static_context(header) | is_uri_context(header)


def is_renamed_union_context(header: Column) -> Column:
    """The same, also where a table's name was put before or after it."""
    named = F.lit(False)
    for s in STATIC:
        named = named | header.startswith(s) | header.endswith(s)
    return F.coalesce(named | header.rlike(r"^uri \d+.*") | is_uri_context(header), F.lit(False))


def is_numbering(header: Column) -> Column:
    """C03, B08."""
    return F.coalesce(header.startswith("Context # of "), F.lit(False))


def is_disambiguation(header: Column) -> Column:
    """C03, B07."""
    return F.coalesce(header.startswith("Disambiguation of "), F.lit(False))


def is_context(header: Column) -> Column:
    """Headers of context columns, whatever their case."""
    h = F.lower(header)
    rule = h.isin(*STATIC) | h.rlike(r"^uri (\d+|\w+(\[\d+\])?)$")
    for p in PREFIXES:
        rule = rule | h.startswith(p.lower())
    return rule


def item_support(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """H14, its counts: (length, pos, value) of path segments and the tables that have them."""
    return _sized_parts(pages, id_col, url_col).groupBy("length", "pos", "value").agg(F.countDistinct(id_col).alias("support"))


def _sized_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    length = F.count("*").over(Window.partitionBy(id_col))
    return uri_path_parts(pages, id_col, url_col).withColumn("length", length)


def greedy_items(base: dict[str, int], patterns: dict[tuple, int], support: dict[tuple[str, int], int], at: int) -> dict[tuple, str]:
    """H14, its loop: the item (pos=value) that each pattern of values goes to. The value that most unclustered tables have at the chosen
    position comes first, there and then at the other positions by support; ties go to the smaller value and position. base: tables of a
    value at that position without other places to go; patterns: (value there, ((pos, value), ...)) -> tables; support: of (value, pos)."""
    left, out, open_values = dict(patterns), {}, set(base) | {u for u, _ in patterns} | {v for _, more in patterns for _, v in more}
    while open_values:
        free = {v: base.get(v, 0) for v in open_values}
        for (u, _), n in left.items():
            if u in free:
                free[u] += n
        best = min(open_values, key=lambda v: (-free[v], v))
        if not free[best]:
            break
        open_values.discard(best)
        for pos in sorted((p for v, p in support if v == best), key=lambda p: (-support[best, p], p)):
            for pattern in [p for p in left if (p[0] == best if pos == at else (pos, best) in p[1])]:
                out[pattern] = f"{pos}={best}"
                del left[pattern]
    return out


def url_clusters(pages: DataFrame, min_support: float = 0.1, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, cluster). Tables are grouped by path length. If the item (value at a position) of most support reaches min_support, the
    tables of a group are clustered by greedy_items() at its position; else the group stays whole.

    Tables none of whose other values stands at that position, too, go with their value there and are never gathered. Only the patterns of
    the others, and counts for the values in them, come to the driver: as many as there are combinations of such values.
    """
    parts = _sized_parts(pages, id_col, url_col).join(pages.select(id_col, F.col(url_col).alias("__url")), id_col)
    support = parts.groupBy("length", "pos", "value").agg(F.countDistinct("__url").alias("support"))
    urls = parts.groupBy("length").agg(F.countDistinct("__url").alias("n"))
    first = Window.partitionBy("length").orderBy(F.desc("support"), "pos", "value")
    split = support.withColumn("k", F.row_number().over(first)).where("k = 1").join(urls, "length").where(F.col("support") >= min_support * F.col("n")).select("length", F.col("pos").alias("at"))
    placed = parts.join(split, "length", "left")
    here = placed.where("pos = at").select(id_col, "length", "at", F.col("value").alias("u"), "__url")
    known = support.join(split, "length").where("pos = at").select("length", F.col("value").alias("known"))
    more = placed.where("pos != at").join(known, ["length"]).where("value = known").join(here.select(id_col, "u"), id_col).where("value != u")
    crossing = more.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("pos", "value"))).alias("more"))
    both = here.join(crossing, id_col, "left")
    patterns = both.where("more is not null").groupBy("length", "at", "u", "more").agg(F.countDistinct("__url").alias("n")).collect()
    chosen = []
    for length, at in sorted({(r["length"], r["at"]) for r in patterns}):
        own = {(r["u"], tuple((m["pos"], m["value"]) for m in r["more"])): r["n"] for r in patterns if r["length"] == length}
        values = sorted({u for u, _ in own} | {v for _, ms in own for _, v in ms})
        group = F.col("length") == length
        base = {r["u"]: r["n"] for r in both.where(group & F.col("more").isNull() & F.col("u").isin(values)).groupBy("u").agg(F.countDistinct("__url").alias("n")).collect()}
        counts = {(r["value"], r["pos"]): r["support"] for r in support.where(group & F.col("value").isin(values)).collect()}
        chosen += [(length, u, [{"pos": p, "value": v} for p, v in ms], item) for (u, ms), item in greedy_items(base, own, counts, at).items()]
    spark = pages.sparkSession
    items = spark.createDataFrame(chosen, "length long, u string, more array<struct<pos: int, value: string>>, item string")
    met = both.join(items, ["length", "u", "more"], "left").select(id_col, F.coalesce("item", F.concat(F.col("at").cast("string"), F.lit("="), "u")).alias("item"))
    lengths = parts.select(id_col, "length").distinct()
    label = F.concat(F.coalesce("length", F.lit(0)).cast("string"), F.lit(":"), F.coalesce("item", F.lit("*")))
    return pages.select(id_col).join(lengths, id_col, "left").join(met, id_col, "left").select(id_col, label.alias("cluster"))
