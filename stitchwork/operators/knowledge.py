"""Matching of tables to the classes and properties of a knowledge base.

kb, web: id, class, property, value (long form). Edges between columns and properties: l (column), r (property), table, class, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.functions import text
from stitchwork.operators import graph, matching, ranking, relational, vectors


def schema_matches(web: DataFrame, kb: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Columns and properties by the cosine of their typed tokens. web: owner, type, v; kb: owner, type, v."""
    tokens = lambda d: d.select("owner", F.explode(text.tokens(F.col("v"))).alias("t"), "type").select("owner", F.concat_ws(":", "type", "t").alias("token"))
    a, b = vectors.vectors(tokens(web)), vectors.vectors(tokens(kb))
    idf = vectors.idf(a, b)
    return vectors.cosine(vectors.tf_idf(a, idf), vectors.tf_idf(b, idf), threshold)


def without_context_labels(edges: DataFrame, columns: DataFrame, label: str = "label") -> DataFrame:
    """Without edges from context columns to the label. columns: col_id, is_context."""
    marked = edges.join(columns.select(F.col("col_id").alias("l"), "is_context"), "l")
    return marked.where((F.col("r") != label) | ~F.col("is_context")).drop("is_context")


def label_mapped(edges: DataFrame, label: str = "label") -> DataFrame:
    """Edges of those tables and classes that have one to the label."""
    have = edges.where(F.col("r") == label).select("table", "class").distinct()
    return edges.join(have, ["table", "class"], "left_semi")


def keys_mapped(edges: DataFrame, keys: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Edges of those tables and classes of which some key is mapped whole; classes without keys pass. keys: class, cols;
    excluded: table, class, cols (keys that do not count for a table)."""
    mapped = edges.groupBy("table", "class").agg(F.collect_set("r").alias("rs"))
    sorted_keys = keys.select("class", F.array_sort("cols").alias("cols"))
    pairs = mapped.join(sorted_keys, "class", "left")
    if excluded is not None:
        pairs = pairs.join(excluded.select("table", "class", F.array_sort("cols").alias("cols")), ["table", "class", "cols"], "left_anti")
    fine = pairs.groupBy("table", "class").agg(F.bool_or(F.col("cols").isNull() | (F.size(F.array_except("cols", "rs")) == 0)).alias("ok")).where("ok")
    return edges.join(fine.select("table", "class"), ["table", "class"], "left_semi")


def excluded_keys(inclusions: DataFrame, tables: DataFrame) -> DataFrame:
    """(table, class, cols): keys of a class that are contained in a key of another class of the same table.
    inclusions: class1, attrs1, class2, attrs2; tables: table, class."""
    a = tables.select("table", F.col("class").alias("class1"))
    b = tables.select("table", F.col("class").alias("class2"))
    chain = inclusions.where("class1 != class2").join(a, "class1").join(b, ["table", "class2"])
    return chain.select("table", F.col("class1").alias("class"), F.col("attrs1").alias("cols")).distinct()


def duplicate_based(links: DataFrame, web: DataFrame, kb: DataFrame, kind: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(l, r, score): mean similarity of the values of linked entities, by the type of column and property.
    links: l, r (entities); web: id, column, v; kb: id, property, v; kind: column, property, type (pairs of one type only)."""
    w = web.select(F.col("id").alias("l"), "column", F.col("v").alias("x"))
    k = kb.select(F.col("id").alias("r"), "property", F.col("v").alias("y"))
    typed = relational.described(w, kind.select("column", "property", "type"), ["column"])
    both = links.select("l", "r").join(typed, "l").join(k, ["r", "property"])
    score = F.when(F.col("type") == "numeric", matching.typed_vote(F.col("x"), F.col("y"), "numeric")).when(F.col("type") == "date", matching.typed_vote(F.col("x"), F.col("y"), "date")).otherwise(matching.typed_vote(F.col("x"), F.col("y"), "string"))
    votes = both.withColumn("score", F.coalesce(score, F.lit(0.0)))
    return votes.groupBy(F.col("column").alias("l"), F.col("property").alias("r")).agg(F.round(F.avg("score"), 6).alias("score")).where(F.col("score") >= threshold)


def consistent(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Scores summed over each column cluster, so that its members choose alike; then a maximum matching of each table and class,
    and each table's class of the largest sum. clusters: col_id, cluster."""
    placed = edges.join(clusters.select(F.col("col_id").alias("l"), "cluster"), "l")
    sums = placed.groupBy("cluster", "class", "r").agg(F.sum("score").alias("sum"))
    scored = placed.join(sums, ["cluster", "class", "r"]).select("table", "class", "l", "r", F.col("sum").alias("score"))
    chosen = ranking.maximum_matching(scored, ["table", "class"])
    total = chosen.groupBy("table", "class").agg(F.sum("score").alias("total"))
    first = F.row_number().over(Window.partitionBy("table").orderBy(F.desc("total"), "class"))
    best = total.withColumn("k", first).where("k = 1").select("table", "class")
    return chosen.join(best, ["table", "class"], "left_semi")


def matched_to_classes(web: DataFrame, kb: DataFrame, clusters: DataFrame, keys: DataFrame, inclusions: DataFrame | None = None, label: str = "label", context: DataFrame | None = None, threshold: float = 0.1, link: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(table, class, l, r, score) of columns and properties, one class for each table, and (table, class, l, r, score) of the linked
    rows and entities. Properties by typed tokens (I22), labels not on context columns (C13), only where the label is mapped (I23); one to
    one within table and class (F06); rows to entities by the label (I24); properties again by the values of linked ones (I25); a key of
    the class mapped whole (I23), no key that another class of the table contains (I27); columns of a cluster alike, best class (I26).

    web: table, id, column, type, v; kb: class, id, property, type, v; clusters: col_id, cluster; keys: class, cols; inclusions: class1,
    attrs1, class2, attrs2; context: col_id, is_context."""
    by_class = graph._cut(schema_matches(web.select(F.col("column").alias("owner"), "type", "v"), kb.select(F.concat_ws("\x1f", "class", "property").alias("owner"), "type", "v"), threshold))
    table_of = web.select(F.col("column").alias("l"), "table").distinct()
    named = by_class.withColumn("class", F.split("r", "\x1f")[0]).withColumn("r", F.split("r", "\x1f")[1]).join(table_of, "l").select("table", "class", "l", "r", "score")
    if context is not None:
        named = without_context_labels(named, context, label)
    fine = graph._cut(ranking.maximum_matching(label_mapped(named, label), ["table", "class"]))

    labels = fine.where(F.col("r") == label).select("table", "class", F.col("l").alias("column"))
    rows = web.join(labels, ["table", "column"]).select(F.concat_ws("\x1f", "table", "id").alias("id"), F.concat_ws("\x1f", "table", "class").alias("class"), F.col("v").alias("label"))
    scope = labels.select("table", "class").distinct()
    entities = kb.where(F.col("property") == label).join(scope, "class").select("id", F.concat_ws("\x1f", "table", "class").alias("class"), F.col("v").alias("label"))
    linked = matching.linked_entities(rows, entities, link)
    part = lambda c, i: F.split(c, "\x1f")[i]
    links = graph._cut(linked.select(part("class", 0).alias("table"), part("class", 1).alias("class"), part("l", 1).alias("l"), "r", "score"))

    w = web.select(F.col("table").cast("string").alias("table"), F.col("id").cast("string").alias("l"), "column", F.col("v").alias("x"), "type")
    k = kb.select("class", F.col("id").alias("r"), "property", F.col("v").alias("y"), F.col("type").alias("t"))
    met = links.select("table", "class", "l", "r").join(w, ["table", "l"]).join(k, ["class", "r"]).where(F.col("type") == F.col("t"))
    vote = F.when(F.col("type") == "numeric", matching.typed_vote(F.col("x"), F.col("y"), "numeric")).when(F.col("type") == "date", matching.typed_vote(F.col("x"), F.col("y"), "date")).otherwise(matching.typed_vote(F.col("x"), F.col("y"), "string"))
    again = met.groupBy("table", "class", "column", "property").agg(F.round(F.avg(F.coalesce(vote, F.lit(0.0))), 6).alias("score")).where(F.col("score") >= threshold)
    again = graph._cut(again.select("table", "class", F.col("column").alias("l"), F.col("property").alias("r"), "score"))
    excluded = excluded_keys(inclusions, again.select("table", "class").distinct()) if inclusions is not None else None
    best = graph._cut(consistent(graph._cut(keys_mapped(label_mapped(again, label), keys, excluded)), clusters))
    return best, links.join(best.select("table", "class").distinct(), ["table", "class"], "left_semi")


def class_extract(kb: DataFrame, kind: str, key: str) -> DataFrame:
    """Entities of a class with a key value, brackets removed, one for each value (that of the smallest id)."""
    rows = kb.where((F.col("class") == kind) & (F.col("property") == key)).select("id", text.without_brackets(F.col("value")).alias("v")).where("v is not null")
    return rows.groupBy("v").agg(F.min("id").alias("id"))


def disambiguation_profile(entities: DataFrame, properties: DataFrame, least: float = 0.05) -> DataFrame:
    """What the brackets of labels hold: (class, what, share) for a year, a decade, the class name, or a property's value. entities: id, class,
    label; properties: id, property, value."""
    noted = entities.withColumn("note", F.lower(text.bracket_text(F.col("label")))).where("note is not null")
    n = noted.groupBy("class").agg(F.count("*").alias("n"))
    year, decade, named = F.col("note").rlike(r"\b\d{4}\b"), F.col("note").rlike(r"\b\d{2,3}0s\b"), F.expr("contains(note, lower(class))")
    own = noted.select("class", "id", F.explode(F.array_compact(F.array(F.when(year, "year"), F.when(decade, "decade"), F.when(named, "class name")))).alias("what"))
    held = noted.join(properties.where("value != ''"), "id").where(F.expr("contains(note, lower(value))")).select("class", "id", F.col("property").alias("what"))
    counts = own.unionByName(held).distinct().groupBy("class", "what").agg(F.count("*").alias("c")).join(n, "class")
    return counts.withColumn("share", F.round(F.col("c") / F.col("n"), 6)).where(F.col("share") >= least).select("class", "what", "share")


def linkage_features(pairs: DataFrame, web: DataFrame, kb: DataFrame, gold: DataFrame) -> DataFrame:
    """(l, r, jaccard, edits, label) of candidate pairs and whether they are right. web, kb: id, label; gold: l, r."""
    from stitchwork.functions import similarity

    side = lambda d, x: d.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"))
    both = pairs.select("l", "r").unionByName(gold.select("l", "r")).distinct().join(side(web, "l"), "l").join(side(kb, "r"), "r")
    right = gold.select("l", "r", F.lit(1).alias("right"))
    scored = both.join(right, ["l", "r"], "left")
    return scored.select("l", "r", similarity.token_jaccard(text.tokens(F.col("l_label")), text.tokens(F.col("r_label"))).alias("jaccard"), similarity.edit_similarity(F.col("l_label"), F.col("r_label")).alias("edits"), F.coalesce("right", F.lit(0)).alias("label"))


def learned_rule(features: DataFrame, columns: list[str]):
    """Logistic regression on similarity features, both labels weighing alike; scores by model.transform()."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = {r["label"]: r["count"] for r in features.groupBy("label").count().collect()}
    total = sum(n.values())
    weight = F.when(F.col("label") == 1, total / (2 * n.get(1, 1))).otherwise(total / (2 * n.get(0, 1)))
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), LogisticRegression(weightCol="weight", labelCol="label")])
    return model.fit(features.fillna(0.0, columns).withColumn("weight", weight))


def swept(candidates: DataFrame, sizes: DataFrame, gold: dict[str, str], entities: list[int], least: list[float]) -> tuple[dict, float]:
    """The parameters of classes_by_linking with the best F1 of column classes, and that F1. gold: column -> class."""
    best = ({}, -1.0)
    for n in entities:
        for score in least:
            found = matching.classes_by_linking(candidates, sizes, n, 0.0, score)
            top = ranking.top_k(found, ["col_id"], [F.desc("score"), "class"], 1).collect()
            right = sum(gold.get(r["col_id"]) == r["class"] for r in top)
            p, r = right / len(top) if top else 0.0, right / len(gold) if gold else 0.0
            f1 = 2 * p * r / (p + r) if p + r else 0.0
            if f1 > best[1]:
                best = ({"min_entities": n, "least": score}, f1)
    return best
