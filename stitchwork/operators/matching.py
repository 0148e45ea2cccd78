"""Matching of columns and records across tables.

cells: table_id, row_id, col_id, v. Edges: l, r (column or record ids), l_table, r_table, score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.functions import text
from stitchwork.operators import graph, ranking, relational, vectors


def to_cells(df: DataFrame, table_id: int, row: str, columns: list[str], prefix: str) -> DataFrame:
    """A wide table in long form, column ids being prefix and name."""
    named = df.select(F.col(row).cast("string").alias("row_id"), *(F.col(c).cast("string").alias(c) for c in columns))
    long = named.unpivot(["row_id"], columns, "name", "v").where("v is not null")
    return long.select(F.lit(table_id).alias("table_id"), "row_id", F.concat(F.lit(prefix + "."), "name").alias("col_id"), "v")


def value_overlap(cells: DataFrame) -> DataFrame:
    """I01, its votes: columns of different tables with the number of distinct values that both have."""
    values = cells.select("table_id", "col_id", "v").distinct()
    a = values.select("v", F.col("col_id").alias("l"), F.col("table_id").alias("l_table"))
    b = values.select("v", F.col("col_id").alias("r"), F.col("table_id").alias("r_table"))
    return a.join(b, "v").where("l_table < r_table").groupBy("l", "r", "l_table", "r_table").agg(F.count("*").cast("double").alias("score"))


def value_matches(cells: DataFrame) -> DataFrame:
    """Of each pair of tables the columns that are each other's best."""
    return ranking.mutual_best(value_overlap(cells))


def value_cosine(cells: DataFrame, threshold: float = 0.2, block_ratio: float | None = None) -> DataFrame:
    """Columns of different tables by the TF-IDF cosine of their cells' tokens; block_ratio as in vectors.dot_products."""
    tokens = cells.select(F.col("col_id").alias("owner"), F.explode(text.tokens(F.col("v"))).alias("token"))
    counted = graph._cut(vectors.vectors(tokens))
    v = vectors.tf_idf(counted, vectors.idf(counted))
    owner = cells.select("col_id", "table_id").distinct()
    found = vectors.cosine(v, v, threshold, block_ratio).where("l < r")
    side = lambda x: owner.select(F.col("col_id").alias(x), F.col("table_id").alias(f"{x}_table"))
    return found.join(side("l"), "l").join(side("r"), "r").where("l_table != r_table").select("l", "r", "l_table", "r_table", "score")


def label_matches(columns: DataFrame, with_context: bool = False) -> DataFrame:
    """Columns of different tables with equal headers. columns: table_id, col_id, header, is_context."""
    c = columns.where("header is not null and header != 'null'")
    c = c if with_context else c.where("not is_context")
    a = c.select(F.col("col_id").alias("l"), F.col("table_id").alias("l_table"), "header")
    b = c.select(F.col("col_id").alias("r"), F.col("table_id").alias("r_table"), F.col("header").alias("h"))
    return a.join(b, (F.col("header") == F.col("h")) & (F.col("l_table") < F.col("r_table"))).select("l", "r", "l_table", "r_table", F.lit(1.0).alias("score"))


def union_matches(columns: DataFrame) -> DataFrame:
    """Columns at the same place, with the same header, of tables with the same schema string; null headers are equal.
    columns: table_id, col_id, ord, header."""
    w = Window.partitionBy("table_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = columns.withColumn("schema", F.array_join(F.collect_list(F.coalesce("header", F.lit(""))).over(w), "+"))
    a = c.select("schema", "ord", F.col("header").alias("h"), F.col("col_id").alias("l"), F.col("table_id").alias("l_table"))
    b = c.select(F.col("schema").alias("s"), F.col("ord").alias("o"), F.col("header").alias("g"), F.col("col_id").alias("r"), F.col("table_id").alias("r_table"))
    same = (F.col("schema") == F.col("s")) & (F.col("ord") == F.col("o")) & F.col("h").eqNullSafe(F.col("g")) & (F.col("l_table") < F.col("r_table"))
    return a.join(b, same).select("l", "r", "l_table", "r_table", F.lit(1.0).alias("score"))


def without_context_edges(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Without edges between two context columns."""
    side = lambda x: columns.select(F.col("col_id").alias(x), F.col("is_context").alias(f"{x}_ctx"))
    return edges.join(side("l"), "l").join(side("r"), "r").where("not (l_ctx and r_ctx)").drop("l_ctx", "r_ctx")


def pairwise_refined(edges: DataFrame, labels: DataFrame, columns: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Edges and label matches together, without pairs of headers that stand together in some table."""
    both = edges.select("l", "r").unionByName(labels.select("l", "r")).distinct()
    side = lambda x: columns.select(F.col("col_id").alias(x), F.col("header").alias(f"{x}_header"))
    named = both.join(side("l"), "l").join(side("r"), "r").withColumns({"a": F.least("l_header", "r_header"), "b": F.greatest("l_header", "r_header")})
    return named.join(disjoint.select(F.col("l").alias("a"), F.col("r").alias("b")), ["a", "b"], "left_anti").select("l", "r")


def fully_mapped(edges: DataFrame, columns: DataFrame, rule: str = "both") -> DataFrame:
    """(l_table, r_table) of tables whose columns are mapped: all of both tables but disambiguations (both), all of one but context
    (one), or at least one that is no context (any). columns: table_id, col_id, header, is_context."""
    from stitchwork.operators import context

    own = columns.where(~context.is_disambiguation(F.col("header")) if rule == "both" else ~F.col("is_context"))
    sizes = own.groupBy("table_id").agg(F.count("*").alias("n"))
    e = edges.join(own.select(F.col("col_id").alias("l")), "l", "left_semi").join(own.select(F.col("col_id").alias("r")), "r", "left_semi")
    m = e.groupBy("l_table", "r_table").agg(F.countDistinct("l").alias("ml"), F.countDistinct("r").alias("mr"))
    m = m.join(sizes.select(F.col("table_id").alias("l_table"), F.col("n").alias("nl")), "l_table").join(sizes.select(F.col("table_id").alias("r_table"), F.col("n").alias("nr")), "r_table")
    test = {"both": "ml = nl and mr = nr", "one": "ml = nl or mr = nr", "any": "ml >= 1"}[rule]
    return m.where(test).select("l_table", "r_table")


def most_columns_mapped(edges: DataFrame, columns: DataFrame, key: str = "FK") -> DataFrame:
    """(l_table, r_table, score) of tables whose keys are matched with each other and more than one column that the union did not add:
    score is how many of these. columns: table_id, col_id, header."""
    from stitchwork.operators import context

    side = lambda x: columns.select(F.col("col_id").alias(x), F.col("header").alias(f"{x}_header"))
    named = edges.join(side("l"), "l").join(side("r"), "r")
    own = F.when(~context.is_union_context(F.col("l_header")), F.col("l"))
    fk = F.coalesce((F.col("l_header") == key) & (F.col("r_header") == key), F.lit(False))
    sums = named.groupBy("l_table", "r_table").agg(F.countDistinct(own).alias("score"), F.bool_or(fk).alias("keyed"))
    return sums.where("keyed and score > 1").select("l_table", "r_table", "score")


def within_table_clusters(edges: DataFrame, fine: DataFrame) -> DataFrame:
    """Edges between tables of one cluster. Pairs of tables that a filter keeps attract, by their score, all other matched pairs
    repel, and clusters are those of H07, made of pairs of tables, which are metadata. fine: l_table, r_table, score (or none for 1)."""
    from stitchwork.operators import graph

    scored = fine if "score" in fine.columns else fine.withColumn("score", F.lit(1.0))
    pairs = edges.select("l_table", "r_table").distinct().join(scored, ["l_table", "r_table"], "left").select("l_table", "r_table", F.coalesce("score", F.lit(-1.0)).alias("score"))
    clusters = graph.signed_clusters([(r["l_table"], r["r_table"], r["score"]) for r in pairs.collect()])
    kind = dict(edges.dtypes)["l_table"]
    place = edges.sparkSession.createDataFrame([(t, i) for i, c in enumerate(clusters) for t in sorted(c)], f"t {kind}, c int")
    side = lambda x: place.select(F.col("t").alias(f"{x}_table"), F.col("c").alias(f"{x}_c"))
    return edges.join(side("l"), "l_table").join(side("r"), "r_table").where("l_c = r_c").select(*edges.columns)


def determinants(source: DataFrame, least: int = 1) -> DataFrame:
    """(table_id, cols) of dependencies (table_id, det, dep), of candidate keys (table_id, cols; at least two columns are asked for as
    a rule) or of subject columns (table_id, col_id): distinct sets of at least so many columns, none that determines itself alone."""
    if "det" in source.columns:
        trivial = (F.size("det") == 1) & (F.array_sort("det") == F.array_sort("dep"))
        sets = source.where(~trivial).select("table_id", F.array_sort("det").alias("cols"))
    elif "cols" in source.columns:
        sets = source.select("table_id", F.array_sort("cols").alias("cols"))
    else:
        sets = source.select("table_id", F.array("col_id").alias("cols"))
    return sets.where(F.size("cols") >= max(1, least)).distinct()


def blocking_tokens(cells: DataFrame, label: str | None = None, prefix: bool = False) -> DataFrame:
    """(row_id, token) for blocks: tokens of all cells, or of the label column's only, with the table in front if asked for."""
    own = cells if label is None else cells.where(F.col("col_id") == label)
    token = F.explode(F.array_distinct(text.tokens(F.col("v")))).alias("t")
    rows = own.select("table_id", "row_id", token)
    return rows.select("row_id", (F.concat_ws(":", F.col("table_id").cast("string"), "t") if prefix else F.col("t")).alias("token")).distinct()


def key_mapped(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """I14, I12 (key forms), I23, D05: (l_table, r_table, left_key, right_key): whether some key of either table is mapped completely.
    keys: table_id, cols (array of column ids)."""
    mapped = edges.groupBy("l_table", "r_table").agg(F.collect_set("l").alias("ls"), F.collect_set("r").alias("rs"))

    def any_key(table: str, columns: str, name: str) -> DataFrame:
        k = keys.select(F.col("table_id").alias(table), "cols")
        full = F.size(F.array_except("cols", columns)) == 0
        return mapped.join(k, table, "left").groupBy("l_table", "r_table").agg(F.coalesce(F.bool_or(full), F.lit(False)).alias(name))

    return any_key("l_table", "ls", "left_key").join(any_key("r_table", "rs", "right_key"), ["l_table", "r_table"])


def duplicates_by_key(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: list[tuple[str, str]]) -> DataFrame:
    """Records (l, r) that agree in all columns of a determinant; nulls never agree."""
    a = left.select(F.col(left_id).alias("l"), *(F.col(x).cast("string").alias(f"k{i}") for i, (x, _) in enumerate(on)))
    b = right.select(F.col(right_id).alias("r"), *(F.col(y).cast("string").alias(f"k{i}") for i, (_, y) in enumerate(on)))
    return relational.all_pairs(a, b, [f"k{i}" for i in range(len(on))]).select("l", "r")


def schema_votes(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """(l, r, score): the share of duplicate records (l, r) in which two columns have the same value, nulls being the same."""
    a = left.select(F.col(left_id).alias("l"), *(F.col(c).cast("string").alias(f"l_{c}") for c in left_columns))
    b = right.select(F.col(right_id).alias("r"), *(F.col(c).cast("string").alias(f"r_{c}") for c in right_columns))
    both = pairs.join(a, "l").join(b, "r")
    shares = {(x, y): F.avg(F.col(f"l_{x}").eqNullSafe(F.col(f"r_{y}")).cast("double")) for x in left_columns for y in right_columns}
    return _votes(both, shares)


def _votes(both: DataFrame, shares: dict[tuple[str, str], Column]) -> DataFrame:
    """(l, r, score) of one row of shares, rounded as in SQL: a half is one of the scaled double."""
    named = {f"v{i}": pair for i, pair in enumerate(shares)}
    row = both.agg(*(shares[pair].alias(v) for v, pair in named.items()))
    each = [F.struct(F.lit(x).alias("l"), F.lit(y).alias("r"), (F.round(F.col(v) * 1e6) / 1e6).alias("score")) for v, (x, y) in named.items()]
    return row.select(F.inline(F.array(*each))).where("score > 0")


def schema_votes_by_key(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """I08 for all pairs of records that agree in a determinant (I07), from the counts of each key's values: pairs of records are counted
    and not made, for all columns by one scan of each side. Column -1 has one value, so that its products are all pairs."""

    def counts(d: DataFrame, keys: list[str], columns: list[str], i: str, n: str) -> DataFrame:
        cells = [F.struct(F.lit(k).alias(i), v.alias("v")) for k, v in [(-1, F.lit(None).cast("string")), *((k, F.col(c).cast("string")) for k, c in enumerate(columns))]]
        keyed = d.select(*(F.col(c).cast("string").alias(f"k{k}") for k, c in enumerate(keys)), F.inline(F.array(*cells)))
        names = [f"k{k}" for k in range(len(keys))]
        return keyed.dropna(subset=names).groupBy(*names, i, "v").agg(F.count("*").cast("decimal(18,0)").alias(n))

    a = counts(left, [x for x, _ in on], left_columns, "i", "n")
    b = counts(right, [y for _, y in on], right_columns, "j", "m").select(*(F.col(f"k{k}").alias(f"h{k}") for k in range(len(on))), F.col("v").alias("w"), "j", "m")
    same = reduce(Column.__and__, (F.col(f"k{k}") == F.col(f"h{k}") for k in range(len(on)))) & F.col("v").eqNullSafe(F.col("w"))
    pairs = lambda i, j: F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("n") * F.col("m"))).cast("double")
    shares = {(x, y): pairs(i, j) / pairs(-1, -1) for i, x in enumerate(left_columns) for j, y in enumerate(right_columns)}
    return _votes(a.join(b, same), shares)


def token_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: Column, right_text: Column, longest: int | None = None) -> DataFrame:
    """(l, r, common) of records with common tokens; tokens of more than `longest` right records make no block."""
    a = left.select(F.col(left_id).alias("l"), F.explode(F.array_distinct(left_text)).alias("token"))
    b = right.select(F.col(right_id).alias("r"), F.explode(F.array_distinct(right_text)).alias("token"))
    if longest:
        b = b.join(b.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= longest).select("token"), "token", "left_semi")
    return a.join(b, "token").groupBy("l", "r").agg(F.count("*").alias("common"))


def full_row_key(columns: list[str]) -> Column:
    """All cell values in order, whatever their columns."""
    return F.array_join(F.array_sort(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))), "~")


def cell_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, score) of rows with common values: how many distinct columns of the right row are met. cells on either side."""
    a = left.select(F.col("row_id").alias("l"), "v").distinct()
    b = right.select(F.col("row_id").alias("r"), F.col("col_id").alias("c"), F.col("v").alias("w"))
    return a.join(b, F.col("v") == F.col("w")).groupBy("l", "r").agg(F.countDistinct("c").alias("score"))


def projected(edges: DataFrame, provenance: DataFrame) -> DataFrame:
    """Edges between source columns carried over to the columns made of them. provenance: target, source."""
    side = lambda x: provenance.select(F.col("source").alias(x), F.col("target").alias(f"{x}_target"))
    both = edges.select("l", "r").join(side("l"), "l").join(side("r"), "r")
    return both.select(F.col("l_target").alias("l"), F.col("r_target").alias("r")).where("l != r").distinct()


def generated_matches(edges: DataFrame, generated: DataFrame) -> DataFrame:
    """Edges between columns generated from matching columns. generated: source, kind, generated."""
    side = lambda x: generated.select(F.col("source").alias(x), F.col("kind").alias(f"{x}_kind"), F.col("generated").alias(f"{x}_new"))
    both = edges.select("l", "r").join(side("l"), "l").join(side("r"), "r").where("l_kind = r_kind")
    return both.select(F.col("l_new").alias("l"), F.col("r_new").alias("r")).distinct()


def translated(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Each column (col_id) with the columns of other tables that it is mapped to."""
    both = edges.select("l", "r").unionByName(edges.select(F.col("r").alias("l"), F.col("l").alias("r")))
    return columns.select("col_id").join(both, F.col("col_id") == F.col("l")).groupBy("col_id").agg(F.array_sort(F.collect_set("r")).alias("mapped"))


def typed_vote(a: Column, b: Column, kind: str) -> Column:
    """Similarity of two values of a type."""
    from stitchwork.functions import similarity

    if kind == "numeric":
        return similarity.deviation(a.try_cast("double"), b.try_cast("double"))
    if kind == "date":
        return similarity.date_similarity(a.try_cast("timestamp"), b.try_cast("timestamp"))
    return similarity.token_jaccard(text.tokens(a), text.tokens(b))


def linked_entities(web: DataFrame, kb: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Records linked to entities of the same class, by label tokens: blocked by class and token, scored by Jaccard on all
    tokens, one to one within a class. web, kb: id, class, label. Labels can only reach the threshold if they share one of their rarest
    tokens (a prefix filter), so that frequent ones make blocks only where a label has no others. Of equal token sets only the smallest id
    can be first for any other record."""
    tok = lambda d, end: d.withColumn("tokens", F.array_sort(F.array_distinct(text.tokens(F.col("label"))))).groupBy("class", "tokens").agg(F.min("id").alias(end))
    w, k = tok(web, "l"), tok(kb, "r")
    counts = k.select("class", F.explode("tokens").alias("token")).groupBy("class", "token").agg(F.count("*").alias("n"))

    def prefix(d: DataFrame, end: str) -> DataFrame:
        long = d.select("class", end, F.col("tokens").alias(f"{end}_tokens"), F.explode("tokens").alias("token")).join(counts, ["class", "token"], "left")
        rows = long.groupBy("class", end, f"{end}_tokens").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("rare"))
        size = F.size("rare")
        # a score rounds up to the threshold from half a millionth below; floating point is given as much again
        length = F.greatest(F.least(size - F.ceil(size * F.lit(threshold - 1e-6)) + 1, size), F.lit(0)).cast("int")
        return rows.select("class", end, f"{end}_tokens", F.explode(F.slice("rare", 1, length)["token"]).alias("token"))

    met = prefix(w, "l").join(prefix(k, "r"), ["class", "token"]).drop("token").distinct()
    common = F.size(F.array_intersect("l_tokens", "r_tokens"))
    scored = met.withColumn("score", F.round(common / (F.size("l_tokens") + F.size("r_tokens") - common), 6)).where(F.col("score") >= threshold)
    first = lambda end, other: F.row_number().over(Window.partitionBy("class", end).orderBy(F.desc("score"), other))
    return scored.withColumn("__l", first("l", "r")).withColumn("__r", first("r", "l")).where("__l = 1 and __r = 1").select("l", "r", "class", "score")


def classes_by_linking(links: DataFrame, sizes: DataFrame, min_entities: int = 3, min_mapped: float = 0.0, least: float = 0.0) -> DataFrame:
    """I32: (col_id, class, score): score = sum of similarities over the number of entities. links: col_id, class, entity, score; sizes: col_id, n.
    Similarities are summed as decimals of 18 places, so that the sum does not depend on the order of rows; what is too large for that (or no
    number) is summed as it is."""
    score = F.col("score").cast("double")
    near = F.abs(score) < 1e9
    exact, rest = F.sum(F.when(near, score).cast("decimal(28,18)")).cast("double"), F.sum(F.when(~near, score))
    sums = links.groupBy("col_id", "class").agg(F.coalesce(exact + rest, exact, rest).alias("sum"), F.countDistinct("entity").alias("mapped")).join(sizes, "col_id")
    # a half is one of the scaled double, as in the SQL; F.round(x, 6) would take the shortest decimal of x instead
    scored = sums.withColumn("score", F.round(F.col("sum") / F.col("n") * 1e6) / 1e6)
    return scored.where((F.col("mapped") >= min_entities) & (F.col("mapped") / F.col("n") >= min_mapped) & (F.col("score") >= least)).select("col_id", "class", "score")


def close_tokens(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(token, other, edits): all pairs of distinct tokens within so many edits. A right token is cut into distance + 1 parts, of which edits
    leave one whole at least; it is looked for in left tokens of a length as close, at places as close."""
    n, cut = F.length("other"), lambda size, i: F.floor(size * i / (distance + 1)).cast("int")
    key = lambda size, i, part: F.concat_ws(":", size, F.lit(i), part)
    parts = [key(n, i, F.substring(F.col("other"), cut(n, i) + 1, cut(n, i + 1) - cut(n, i))) for i in range(distance + 1)]
    index = right.select(F.col("token").alias("other")).distinct().select("other", F.explode(F.array(*parts)).alias("key"))
    places = []
    for more in range(-distance, distance + 1):
        size = F.length("token") + more
        for i in range(distance + 1):
            begin, length = cut(size, i), cut(size, i + 1) - cut(size, i)
            for shift in range(-distance, distance + 1):
                inside = (size >= 0) & (begin + shift >= 0) & (begin + shift + length <= F.length("token"))
                places.append(F.when(inside, key(size, i, F.substring(F.col("token"), begin + shift + 1, length))))
    looked = left.select("token").distinct().select("token", F.explode(F.array_distinct(F.array_compact(F.array(*places)))).alias("key"))
    met = looked.join(index, "key").select("token", "other").distinct()
    return met.withColumn("edits", F.levenshtein("token", "other", distance)).where("edits >= 0")


def fuzzy_lookup(queries: DataFrame, index: DataFrame, distance: int = 2, k: int = 50) -> DataFrame:
    """For each label the k nearest labels of the index that share a token with it up to so many edits. queries, index: id, label, class."""
    grams = lambda d, name: d.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"), F.col("class").alias(f"{name}_class"), F.explode(F.array_distinct(text.tokens(F.col("label")))).alias("token"))
    a, b = grams(queries, "q"), grams(index, "i")
    met = a.join(close_tokens(a, b, distance), "token").join(b.withColumnRenamed("token", "other"), "other")
    met = met.where("q_class is null or q_class = i_class").groupBy("q", "q_label", "i", "i_label").agg(F.min("edits").alias("edits"), F.countDistinct("token").alias("common"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("common"), "edits", F.levenshtein("q_label", "i_label"), "i"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "i", "common", "edits", "rank")


def determinant_matches(determinants: DataFrame, edges: DataFrame) -> DataFrame:
    """(l, r) of determinants of different tables whose columns lie in the same clusters. determinants: det_id, table_id, cols."""
    from stitchwork.operators import graph

    cluster = graph.components(edges.select("l", "r"))
    long = determinants.select("det_id", "table_id", F.explode("cols").alias("col")).join(cluster, F.col("col") == F.col("node"), "left")
    key = long.groupBy("det_id", "table_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("component", "col"))), "+").alias("key"))
    other = key.select(F.col("det_id").alias("r"), F.col("table_id").alias("t"), F.col("key").alias("k"))
    return key.join(other, (F.col("key") == F.col("k")) & (F.col("table_id") < F.col("t"))).select(F.col("det_id").alias("l"), "r")


def context_fallback(a: Column, b: Column, context: Column) -> Column:
    """Equality of two values, a null one agreeing with a value that the row's context has."""
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull(), F.array_contains(context, b).cast("double")).otherwise(F.coalesce((a == b).cast("double"), F.lit(0.0)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def propagated_determinants(determinants: DataFrame, edges: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(table_id, cols): determinants carried over to the tables that all their columns match columns of, until none is new; without
    supersets of others and without those of context columns only. determinants: table_id, cols; edges: l, r, l_table, r_table."""
    from stitchwork.operators.graph import _cut

    ways = edges.select("l", "r", "l_table", "r_table").unionByName(edges.select(F.col("r").alias("l"), F.col("l").alias("r"), F.col("r_table").alias("l_table"), F.col("l_table").alias("r_table")))
    ways = ways.groupBy("l_table", "r_table", "l").agg(F.min("r").alias("r"))
    known = _cut(determinants.select("table_id", F.array_sort("cols").alias("cols")).distinct())
    while True:
        long = known.select("table_id", "cols", F.explode("cols").alias("l"))
        moved = long.join(ways, (F.col("table_id") == F.col("l_table")) & (long["l"] == ways["l"])).groupBy("table_id", "cols", "r_table").agg(F.array_sort(F.collect_set("r")).alias("new"))
        fresh = moved.where(F.size("new") == F.size("cols")).select(F.col("r_table").alias("table_id"), F.col("new").alias("cols")).distinct()
        new = _cut(fresh.join(known, ["table_id", "cols"], "left_anti"))
        if new.isEmpty():
            break
        known = _cut(known.unionByName(new))
    smaller = known.select(F.col("table_id").alias("t"), F.col("cols").alias("part"))
    minimal = known.join(smaller, (F.col("table_id") == F.col("t")) & (F.size("part") < F.size("cols")) & (F.size(F.array_except("part", "cols")) == 0), "left_anti")
    if context is None:
        return minimal
    marked = minimal.select("table_id", "cols", F.explode("cols").alias("c")).join(context.select(F.col("col_id").alias("c")), "c", "left_anti")
    return minimal.join(marked.select("table_id", "cols").distinct(), ["table_id", "cols"], "left_semi")


def merged_context_edges(edges: DataFrame, context: DataFrame, columns: DataFrame) -> DataFrame:
    """Edges and those context edges of which both ends are unmatched so far, or have equal headers. columns: col_id, header."""
    used = edges.select(F.col("l").alias("c")).union(edges.select("r")).distinct().withColumn("used", F.lit(True))
    side = lambda x: columns.select(F.col("col_id").alias(x), F.col("header").alias(f"{x}_header")).join(used.select(F.col("c").alias(x), F.col("used").alias(f"{x}_used")), x, "left")
    both = context.select("l", "r").join(side("l"), "l").join(side("r"), "r")
    fine = both.where((F.col("l_used").isNull() & F.col("r_used").isNull()) | (F.col("l_header") == F.col("r_header")))
    return edges.select("l", "r").unionByName(fine.select("l", "r")).distinct()


def context_edges(columns: DataFrame) -> DataFrame:
    """Edges between equal context headers of tables of one cluster. columns: table_id, col_id, header, cluster, is_context."""
    c = columns.where("is_context")
    b = c.select("cluster", "header", F.col("col_id").alias("r"), F.col("table_id").alias("r_table"))
    return c.select("cluster", "header", F.col("col_id").alias("l"), F.col("table_id").alias("l_table")).join(b, ["cluster", "header"]).where("l_table < r_table").select("l", "r", "l_table", "r_table")


def foreign_key_refined(edges: DataFrame, vector: DataFrame, columns: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges between context columns, of equal headers or not numeric stay; the others are scored anew on vectors of tokens with
    their row's foreign key. columns: col_id, header, type, is_context."""
    side = lambda x: columns.select(F.col("col_id").alias(x), F.col("header").alias(f"{x}_h"), F.col("type").alias(f"{x}_t"), F.col("is_context").alias(f"{x}_c"))
    named = edges.select("l", "r", "score").join(side("l"), "l").join(side("r"), "r")
    stay = (F.col("l_c") & F.col("r_c")) | F.col("l_h").eqNullSafe(F.col("r_h")) | (F.col("l_t") != "numeric")
    again = vectors.rescored(named.where(~stay), vector, threshold)
    return named.where(stay).select("l", "r", "score").unionByName(again)


def foreign_key_tokens(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(owner, token) with tokens of foreign key, type and value. keys: row_id, fk."""
    typed = F.when(F.col("v").try_cast("double").isNotNull(), "numeric").otherwise("string")
    return cells.join(keys, "row_id").select(F.col("col_id").alias("owner"), F.concat_ws("|", "fk", typed, "v").alias("token"))


def cell_keys(cells: DataFrame, label_column: str) -> DataFrame:
    """(row_id, key): the table and the label cell's value."""
    return cells.where((F.col("col_id") == label_column) & F.col("v").isNotNull()).select("row_id", F.concat_ws("~", F.col("table_id").cast("string"), "v").alias("key"))


def full_key_entities(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(class, key, token, n): blocks of entities whose key's columns are all filled, by tokens of the key's values. cells: row_id,
    class, property, v; keys: class, cols."""
    k = keys.select("class", F.array_sort("cols").alias("cols"), F.array_join(F.array_sort("cols"), "+").alias("key"))
    held = cells.where("v is not null").join(k, "class").where(F.expr("array_contains(cols, property)"))
    rows = held.groupBy("class", "key", F.size("cols").alias("need"), "row_id").agg(F.array_sort(F.collect_set(F.struct("property", "v"))).alias("vs")).where("size(vs) = need")
    entity = F.expr("array_join(transform(vs, x -> x.v), '~')")
    blocks = rows.select("class", "key", entity.alias("entity")).distinct().withColumn("token", F.explode(F.array_distinct(text.tokens(F.col("entity")))))
    return blocks.groupBy("class", "key", "token").agg(F.count("*").alias("n"))


def matched(cells: DataFrame | None, columns: DataFrame, matcher: str | DataFrame = "label", threshold: float = 0.2) -> DataFrame:
    """A matcher's edges (label, value or cosine of values, the last two from a threshold on; or edges l, r), refined by pairs of headers, by
    graph and by transitivity: (l, r), all pairs of each component. cells: table_id, row_id, col_id, v; columns: table_id, col_id, header,
    is_context."""
    ends = lambda e: e.join(columns.select(F.col("col_id").alias("l")), "l", "left_semi").join(columns.select(F.col("col_id").alias("r")), "r", "left_semi")
    labels = label_matches(columns)
    if isinstance(matcher, DataFrame):
        edges = matcher
    elif matcher == "value":
        sizes = cells.groupBy("col_id").agg(F.countDistinct("v").alias("n"))
        side = lambda x: sizes.select(F.col("col_id").alias(x), F.col("n").alias(f"{x}_n"))
        share = F.col("score") / F.least("l_n", "r_n")
        edges = value_matches(cells).join(side("l"), "l").join(side("r"), "r").where(share >= threshold)
    elif matcher == "cosine":
        edges = value_cosine(cells, threshold)
    else:
        edges = labels
    disjoint = graph.disjoint_headers(columns.select("table_id", "header"))
    pairwise = graph._cut(pairwise_refined(ends(edges.select("l", "r")), labels, columns, disjoint))
    return graph.closure_pairs(graph._cut(graph.refined(pairwise, columns, disjoint))).where("l < r")
