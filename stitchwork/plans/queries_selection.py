"""Queries: cleaning, context, selections, joins on metadata, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.catalog import query
from stitchwork.functions import similarity, text
from stitchwork.operators import context, knowledge, patterns, profile, ranking, relational, selection, stitching, vectors
from stitchwork.plans.queries_data import PAIRS, SCORES, SPARSE, _pairs, _scored, _sparse, l13_tuple_listing, table
from stitchwork.plans.queries_matching import CELLS, COLUMN_ROWS, _cells, _columns

TIME_TEXT = "cells AS (SELECT o_orderkey, o_orderpriority || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at ' || (o_orderkey % 12) || ':30 pm or ' || strftime(o_orderdate, '%B') || ' for ' || o_custkey || ' days ok' AS v FROM orders)"
TIME = r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|\d{1,2}:\d{2}(:\d{2})?( ?[ap]m)?|\d{1,2} ?[ap]m|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?( \d{1,2},?)?( \d{4})?|(mon|tues|wednes|thurs|fri|satur|sun)day|(19|20)\d{2}(-(19|20)?\d{2})?|\d+ (second|minute|hour|day|week|month|year)s?)\b"


@query(f"WITH {TIME_TEXT} SELECT o_orderkey, nullif(trim(regexp_replace(regexp_replace(v, '{TIME}', '', 'g'), '\\s+', ' ', 'g')), '') AS v FROM cells")
def b16_without_time(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.concat("o_orderpriority", F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at "), (F.col("o_orderkey") % 12).cast("string"), F.lit(":30 pm or "), F.date_format("o_orderdate", "MMMM"), F.lit(" for "), F.col("o_custkey").cast("string"), F.lit(" days ok"))
    return o.select("o_orderkey", text.without_time(v).alias("v"))


@query(r"SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^Customer#(0*)([0-9]*)$') THEN regexp_extract(c_name, '^Customer#(0*)([0-9]*)$', 2) END AS second FROM customer")
def b18_applied_pattern(spark, sf_dir):
    found = patterns.applied(F.col("c_name"), ["Supplier#(.*)(x)", "Customer#(0*)([0-9]*)"])
    return table(spark, sf_dir, "customer").select("c_custkey", found[1].alias("second"))


@query("SELECT c_nationkey AS table_id FROM customer GROUP BY 1 HAVING count(*) % count(DISTINCT c_mktsegment) = 0 AND count(DISTINCT c_mktsegment) = 1 AND count(*) > 1 UNION ALL SELECT 1000 + n_nationkey FROM nation")
def b19_stacked_tables(spark, sf_dir):
    """Segments of a nation's customers in order, and three headers twice side by side."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("header"))
    sizes = c.groupBy("table_id").agg(F.countDistinct("header").alias("k")).where("k = 1")
    same = c.join(sizes, "table_id", "left_semi")
    twice = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).alias("table_id"), F.posexplode(F.array(*map(F.lit, "abcabc"))).alias("ord", "header"))
    plain = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).alias("table_id"), F.posexplode(F.array(*map(F.lit, "abcacb"))).alias("ord", "header"))
    return stitching.stacked_tables(same.unionByName(twice).unionByName(plain))


@query("SELECT n_regionkey AS table_id, 'key' AS col_id, CAST(min(n_nationkey) AS VARCHAR) AS header FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 'name', arg_min(n_name, n_nationkey) FROM nation GROUP BY 1")
def b20_repaired_header(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("row_id"), F.expr("stack(2, 'key', cast(n_nationkey as string), 'name', n_name) as (col_id, v)"))
    empty = n.select(F.col("n_regionkey").alias("table_id"), F.lit(-1).alias("row_id"), F.lit("key").alias("col_id"), F.lit(None).cast("string").alias("v"))
    return stitching.repaired_header(rows.unionByName(empty))


@query("SELECT 'customer' AS \"table\", CASE WHEN count(DISTINCT c_name) >= count(DISTINCT c_mktsegment) THEN 'c_name' ELSE 'c_mktsegment' END AS subject FROM customer UNION ALL SELECT 'orders', CASE WHEN count(DISTINCT o_orderstatus) >= count(DISTINCT o_orderpriority) THEN 'o_orderstatus' ELSE 'o_orderpriority' END FROM orders")
def b22_subject_columns(spark, sf_dir):
    named = {"customer": ["c_name", "c_mktsegment", "c_acctbal"], "orders": ["o_orderstatus", "o_orderpriority", "o_totalprice"]}
    return spark.createDataFrame([(t, stitching.subject_column(table(spark, sf_dir, t), c, 0.0)) for t, c in named.items()], "table string, subject string")


@query("SELECT n_regionkey, round(max(1 - levenshtein(a, b) / greatest(length(a), length(b))), 6) AS best, round(min(1 - levenshtein(a, b) / greatest(length(a), length(b))), 6) AS worst FROM (SELECT x.n_regionkey, x.n_name AS a, r_name AS b FROM nation x JOIN region ON true) GROUP BY 1")
def b25_list_similarities(spark, sf_dir):
    """Lists of names against the list of all regions."""
    regions = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("own")).withColumn("names", regions.scalar())
    return n.select("n_regionkey", F.round(similarity.over_lists(F.col("own"), F.col("names"), similarity.edit_similarity), 6).alias("best"), F.round(similarity.over_lists(F.col("own"), F.col("names"), similarity.edit_similarity, strict=True), 6).alias("worst"))


@query("SELECT c_name, c_mktsegment FROM customer")
def c02_without_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return selection.without_keys(c.select(F.col("c_custkey").alias("PK"), F.col("c_nationkey").alias("Fk"), "c_name", "c_mktsegment"))


HEADERS = "h AS (SELECT DISTINCT unnest([p_type, 'uri ' || p_size % 3, 'uri q' || p_size % 2, 'uri 1' || p_type, 'Disambiguation of ' || p_name, 'Context # of ' || p_type, 'page title', p_type || ' table heading']) AS header FROM part)"


@query(rf"""WITH {HEADERS} SELECT header, header IN ('page title', 'table heading') AS static, regexp_matches(header, '^uri \w+$') AS uri, header IN ('page title', 'table heading') OR regexp_matches(header, '^uri \w+$') AS added,
header LIKE 'page title%' OR header LIKE '%page title' OR header LIKE 'table heading%' OR header LIKE '%table heading' OR regexp_matches(header, '^uri \d+.*') OR regexp_matches(header, '^uri \w+$') AS renamed, header LIKE 'Context # of %' AS numbering, header LIKE 'Disambiguation of %' AS disambiguation FROM h""")
def c03_context_predicates(spark, sf_dir):
    size = F.col("p_size")
    heads = F.array("p_type", F.concat(F.lit("uri "), (size % 3).cast("string")), F.concat(F.lit("uri q"), (size % 2).cast("string")), F.concat(F.lit("uri 1"), "p_type"), F.concat(F.lit("Disambiguation of "), "p_name"), F.concat(F.lit("Context # of "), "p_type"), F.lit("page title"), F.concat("p_type", F.lit(" table heading")))
    h = table(spark, sf_dir, "part").select(F.explode(heads).alias("header")).distinct()
    c = F.col("header")
    return h.select("header", context.is_static_context(c).alias("static"), context.is_uri_context(c).alias("uri"), context.is_union_context(c).alias("added"), context.is_renamed_union_context(c).alias("renamed"), context.is_numbering(c).alias("numbering"), context.is_disambiguation(c).alias("disambiguation"))


@query(f"WITH {SPARSE} SELECT * FROM sparse WHERE status IS NOT NULL OR priority IS NOT NULL")
def c04_rows_with_content(spark, sf_dir):
    return relational.has_content(_sparse(spark, sf_dir), ["status", "priority"])


@query(f"WITH {SPARSE} SELECT o_custkey, priority FROM sparse")
def c05_dense_columns(spark, sf_dir):
    return relational.without_sparse_columns(_sparse(spark, sf_dir), 0.4)


EDGES = "e AS (SELECT c_nationkey AS l, c_mktsegment AS r, c_nationkey % 5 AS \"table\", 'k' || c_nationkey % 2 AS class, round(sum(c_acctbal), 2) AS total, count(*) AS cells, CAST(count(*) AS DOUBLE) AS score FROM customer GROUP BY c_nationkey, c_mktsegment)"


def _edges(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    counts = c.groupBy(n.alias("l"), F.col("c_mktsegment").alias("r")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.count("*").alias("cells"), F.count("*").cast("double").alias("score"))
    return counts.select("l", "r", (F.col("l") % 5).alias("table"), F.concat(F.lit("k"), (F.col("l") % 2).cast("string")).alias("class"), "total", "cells", "score")


@query(f"WITH {EDGES} SELECT l, r, score FROM e WHERE r <> 'BUILDING' OR l >= 7")
def c13_no_context_labels(spark, sf_dir):
    columns = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("col_id"), (F.col("n_nationkey") < 7).alias("is_context"))
    return knowledge.without_context_labels(_edges(spark, sf_dir), columns, "BUILDING").select("l", "r", "score")


@query("SELECT 'orders' AS \"table\", 'o_orderstatus' AS attribute, '{\"o_orderkey\":\"' || o_orderkey || '\"}' AS key, o_orderstatus AS value, 'states' AS output FROM orders WHERE o_orderstatus IS NOT NULL")
def c14_selected_tuples(spark, sf_dir):
    wanted = spark.createDataFrame([("orders", "o_orderstatus", "states"), ("parts", "o_orderpriority", "none")], "table string, attribute string, output string")
    return selection.selected_tuples(l13_tuple_listing(spark, sf_dir), wanted)


@query(f"WITH {EDGES}, p AS (SELECT n_nationkey AS k, round(count(c_custkey) FILTER (c_acctbal > 0) / count(*), 6) AS density FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT l, r, score FROM e JOIN p ON l = k WHERE density >= 0.9")
def c15_dense_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("column")).agg(F.round(F.count(F.when(F.col("c_acctbal") > 0, 1)) / F.count("*"), 6).alias("density"))
    return selection.dense_edges(_edges(spark, sf_dir), c, 0.9).select("l", "r", "score")


@query(f"WITH {EDGES}, rel AS (SELECT c_mktsegment AS t, list(DISTINCT c_nationkey % 5) AS cols FROM customer GROUP BY 1) SELECT min(t) AS \"table\" FROM rel WHERE len(cols) = (SELECT max(len(cols)) FROM rel)")
def c16_first_filler(spark, sf_dir):
    """The first table that comes back to cover what is missing."""
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.collect_set(F.col("c_nationkey") % 5).alias("cols")).collect()
    found = relational.fill_cover({r["c_mktsegment"]: set(r["cols"]) for r in rows}, set(range(5)))
    return spark.createDataFrame([(found[0],)], "table string")


@query("SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS target FROM orders GROUP BY 1")
def d03_translated_rows(spark, sf_dir):
    mapping = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("target"), F.col("o_orderkey").alias("pos"))
    return stitching.translated_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), mapping)


NAME_TOKENS = "tok AS (SELECT p_brand AS owner, unnest(string_split(p_name, ' ')) AS token FROM part), vec AS (SELECT owner, token, count(*) / (SELECT count(DISTINCT token) FROM tok x WHERE x.owner = tok.owner) AS w FROM tok GROUP BY owner, token)"


def _name_tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.explode(F.split("p_name", " ")).alias("token"))


@query(f"""WITH {NAME_TOKENS}, b AS (SELECT token, count(*) * count(*) AS size FROM vec GROUP BY 1), k AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM b),
kept AS (SELECT token FROM b WHERE size <= (SELECT size FROM k WHERE i = greatest(0, CAST(floor(n * 0.5) AS BIGINT) - 1)))
SELECT a.owner AS l, b.owner AS r, round(sum(a.w * b.w), 6) AS dot, count(*) AS common FROM vec a JOIN vec b ON a.token = b.token AND a.owner <> b.owner WHERE a.token IN (SELECT token FROM kept) GROUP BY 1, 2""")
def d14_filtered_dot_products(spark, sf_dir):
    v = vectors.vectors(_name_tokens(spark, sf_dir))
    return vectors.dot_products(v, v, 0.5).withColumn("dot", F.round("dot", 6))


@query("SELECT n_nationkey AS \"table\", c.seg AS match, coalesce(c.score, 0) AS score FROM nation LEFT JOIN (SELECT c_nationkey, max(c_mktsegment) AS seg, max(c_acctbal) AS score FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON c_nationkey = n_nationkey")
def d16_reference_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("table")).agg(F.max("c_mktsegment").alias("seg"), F.max("c_acctbal").alias("score"))
    match = F.concat_ws("|", F.col("table").cast("string"), "seg").alias("match")
    found = selection.reference_scores(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("table")), c.select("table", match), c.select(match, "score"))
    return found.withColumn("match", F.split("match", r"\|")[1])


@query(f"WITH {EDGES}, w AS (SELECT c_mktsegment AS id, round(avg(c_acctbal), 4) AS weight FROM customer GROUP BY 1) SELECT l, r, round(score * weight, 4) AS score FROM e JOIN w ON r = id")
def d17_weighted_edges(spark, sf_dir):
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("id")).agg(F.round(F.avg("c_acctbal"), 4).alias("weight"))
    return selection.weighted_edges(_edges(spark, sf_dir).select("l", "r", "score"), w).withColumn("score", F.round("score", 4))


@query(f"WITH {CELLS} SELECT table_id, row_id, v AS label FROM cells WHERE col_id IN ('customer.c_name', 'nation.n_name')")
def d19_labelled_records(spark, sf_dir):
    labels = spark.createDataFrame([(0, "customer.c_name"), (2, "nation.n_name")], "table_id int, label string")
    return selection.labelled_records(_cells(spark, sf_dir), labels)


@query("SELECT c_nationkey, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS share FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)")
def e02_distribution(spark, sf_dir):
    return profile.distribution(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total, max(l_extendedprice) AS top, count(DISTINCT l_linestatus) AS kinds FROM lineitem GROUP BY 1")
def e01_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.max("l_extendedprice").alias("top"), F.countDistinct("l_linestatus").alias("kinds"))


@query(f"WITH {EDGES}, s AS (SELECT l % 5 AS t, count(*) AS n FROM e GROUP BY 1) SELECT l, r, round(sum(score) / max(n), 6) AS score FROM e JOIN s ON \"table\" = t WHERE l % 2 = 0 GROUP BY l, r HAVING round(sum(score) / max(n), 6) >= 0.2")
def e03_votes(spark, sf_dir):
    """Votes count where the types of both columns are equal (here, on even nations)."""
    e = _edges(spark, sf_dir)
    sizes = e.groupBy(F.col("table").alias("l_table")).agg(F.count("*").alias("n_rows"))
    typed = e.select("l", "r", F.col("table").alias("l_table"), F.when(F.col("l") % 2 == 0, "string").otherwise("numeric").alias("l_type"), F.lit("string").alias("r_type"), "score")
    return profile.votes(typed, sizes, 0.2)


@query(f"WITH {CELLS} SELECT table_id, count(DISTINCT row_id) AS n_rows, count(DISTINCT col_id) AS n_columns, count(v) AS n_cells FROM cells GROUP BY 1")
def e10_table_statistics(spark, sf_dir):
    return profile.table_statistics(_cells(spark, sf_dir))


@query("SELECT size, count(*) AS n FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY 1")
def e10_fusion_statistics(spark, sf_dir):
    return profile.fusion_statistics(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster")))


DEPENDENCIES = "deps AS (SELECT c_nationkey AS table_id, list(DISTINCT c_mktsegment) AS dep, list(DISTINCT c_custkey % 3) AS det FROM customer GROUP BY 1)"


def _dependencies(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("table_id")).agg(F.collect_set("c_mktsegment").alias("dep"), F.collect_set((F.col("c_custkey") % 3).cast("string")).alias("det"))


@query(f"WITH {DEPENDENCIES} SELECT table_id, count(*) AS n_dependencies, round(avg(len(det)), 6) AS n_determinant, round(avg(len(dep)), 6) AS n_dependants FROM deps GROUP BY 1")
def e10_dependency_statistics(spark, sf_dir):
    return profile.dependency_statistics(_dependencies(spark, sf_dir))


@query(f"WITH {DEPENDENCIES}, a AS (SELECT table_id, unnest(dep) AS d FROM deps) SELECT x.d AS l, y.d AS r, count(*) AS n FROM a x JOIN a y ON x.table_id = y.table_id AND x.d < y.d GROUP BY 1, 2")
def e10_dependant_pairs(spark, sf_dir):
    return profile.dependant_pairs(_dependencies(spark, sf_dir))


@query(r"""WITH n AS (SELECT c_mktsegment AS class, c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '1990s' WHEN 1 THEN lower(c_mktsegment) || ' x' WHEN 2 THEN 'nation ' || c_nationkey END AS note, 'nation ' || c_nationkey AS value FROM customer),
k AS (SELECT * FROM n WHERE note IS NOT NULL), t AS (SELECT class, count(*) AS n FROM k GROUP BY 1),
w AS (SELECT class, id, 'decade' AS what FROM k WHERE regexp_matches(note, '\b\d{2,3}0s\b') UNION ALL SELECT class, id, 'class name' FROM k WHERE contains(note, lower(class)) UNION ALL SELECT class, id, 'home' FROM k WHERE contains(note, value))
SELECT class, what, round(count(*) / max(n), 6) AS share FROM w JOIN t USING (class) GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.05""")
def e16_disambiguation_profile(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    nation = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    note = F.when(k == 0, F.concat("c_name", F.lit(" (1990s)"))).when(k == 1, F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(" x)"))).when(k == 2, F.concat("c_name", F.lit(" ("), nation, F.lit(")"))).otherwise(F.col("c_name"))
    entities = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class"), note.alias("label"))
    return knowledge.disambiguation_profile(entities, c.select(F.col("c_custkey").alias("id"), F.lit("home").alias("property"), nation.alias("value")))


@query("""WITH s AS (SELECT c_nationkey AS "table", c_mktsegment AS class, round(sum(c_acctbal), 2) AS score, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT c_nationkey, count(*) AS e FROM customer GROUP BY 1), k AS (SELECT s.*, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, class) AS k FROM s JOIN t ON c_nationkey = "table" WHERE n >= 2 AND n >= 0.2 * e) SELECT "table", class, score, n FROM k WHERE k = 1""")
def e18_classes_with_enough_matches(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sizes = c.groupBy(F.col("c_nationkey").alias("table")).agg(F.count("*").alias("n_entities"))
    found = profile.class_argmax(c.select(F.col("c_nationkey").alias("table"), F.col("c_mktsegment").alias("class"), F.col("c_acctbal").alias("score")), 2, sizes, 0.2)
    return found.withColumn("score", F.round("score", 2))


@query(f"WITH {EDGES} SELECT l, r, \"table\", round(score / max(score) OVER w * (cells + 1.0) / (max(cells) OVER w + 1.0), 6) AS score FROM e WINDOW w AS (PARTITION BY \"table\")")
def e19_normalised_scores(spark, sf_dir):
    return selection.normalised_scores(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY l_table, r_table ORDER BY score DESC, l, r) AS k FROM scored),
g AS (SELECT l_table, r_table, k, l, r, score, [l] AS ls, [r] AS rs, true AS taken FROM o WHERE k = 1 UNION ALL
SELECT o.l_table, o.r_table, o.k, o.l, o.r, o.score, CASE WHEN list_contains(ls, o.l) OR list_contains(rs, o.r) THEN ls ELSE list_append(ls, o.l) END, CASE WHEN list_contains(ls, o.l) OR list_contains(rs, o.r) THEN rs ELSE list_append(rs, o.r) END, NOT (list_contains(ls, o.l) OR list_contains(rs, o.r))
FROM g JOIN o ON o.l_table = g.l_table AND o.r_table = g.r_table AND o.k = g.k + 1) SELECT l_table, r_table, l, r, score FROM g WHERE taken""")
def f05_greedy_one_to_one(spark, sf_dir):
    return ranking.greedy_one_to_one(_scored(spark, sf_dir), ["l_table", "r_table"])


@query("SELECT o_custkey AS \"table\", n, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS id FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def f10_ids_by_size(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("table")).agg(F.count("*").alias("n"))
    return profile.numbered(sizes, [F.desc("n"), "table"])


@query(f"WITH {DEPENDENCIES}, t AS (SELECT table_id, list_aggregate(list_sort(det), 'string_agg', ',') AS det FROM deps) SELECT table_id, row_number() OVER (ORDER BY det, table_id) - 1 AS id FROM t")
def f11_dependency_ids(spark, sf_dir):
    named = _dependencies(spark, sf_dir).select("table_id", F.array_join(F.array_sort("det"), ",").alias("det"))
    return profile.numbered(named, ["det", "table_id"]).select("table_id", "id")


@query(f"WITH {PAIRS} SELECT l, r FROM edges UNION SELECT r, l FROM edges")
def h01_union_distinct(spark, sf_dir):
    e = _pairs(spark, sf_dir)
    return e.union(e.select("r", "l")).distinct()


@query(f"WITH {PAIRS} SELECT l, r FROM edges EXCEPT SELECT r, l FROM edges")
def h03_removed(spark, sf_dir):
    e = _pairs(spark, sf_dir)
    return relational.missing_edges(e, e.select(F.col("r").alias("l"), F.col("l").alias("r")))


@query(f"WITH {COLUMN_ROWS} SELECT a.header || '+' || b.header AS pair, count(*) AS n FROM columns a JOIN columns b ON a.table_id = b.table_id AND a.header < b.header GROUP BY 1")
def h16_attribute_pairs(spark, sf_dir):
    return stitching.attribute_table_clusters(_columns(spark, sf_dir).select("table_id", F.col("header").alias("cluster")))
