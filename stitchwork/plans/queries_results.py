"""Queries: dependency algebra on discovered dependencies, graphs, stitched and fused tables, evaluation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.catalog import query
from stitchwork.operators import context, dependencies, duplicates, evaluation, graph, knowledge, matching, selection, stitching
from stitchwork.plans import dependencies as algebra
from stitchwork.plans.queries_data import DENORMALISED, PAIRS, QUERY_PARTS, SCHEMA, _denormalised, _pairs, h14_url_clusters, table
from stitchwork.plans.queries_matching import ANCESTORS, COLUMN_ROWS, COMPONENTS, LABELS, _columns, _hierarchy

#: Whether one column determines another one, for all pairs of the denormalised table, by counting.
PAIRS_HOLD = ", holds AS (" + " UNION ALL ".join(f"SELECT '{a}' AS det, '{b}' AS dep, (SELECT count(DISTINCT {a}) FROM d) = (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM d)) AS ok" for a in SCHEMA for b in SCHEMA if a != b) + ")"


def _rows(spark, fds: algebra.Fds) -> DataFrame:
    return spark.createDataFrame([("+".join(sorted(det)), a) for det, a in algebra.split(fds)], "det string, dep string")


def _discovered(spark, sf_dir) -> algebra.Fds:
    return dependencies.discover(_denormalised(spark, sf_dir), SCHEMA, 1)


@query(f"WITH {DENORMALISED}{PAIRS_HOLD} SELECT det, dep FROM holds WHERE ok")
def g13_exact_dependencies(spark, sf_dir):
    return _rows(spark, _discovered(spark, sf_dir))


@query(f"WITH {DENORMALISED}{PAIRS_HOLD} SELECT det, dep FROM holds WHERE ok UNION SELECT det, det FROM holds")
def g01_closures(spark, sf_dir):
    """The closure of each column; exact dependencies of data are closed under transitivity."""
    fds = _discovered(spark, sf_dir)
    return _rows(spark, {frozenset([a]): algebra.closure([a], fds) for a in SCHEMA})


@query(f"WITH {DENORMALISED}{PAIRS_HOLD} SELECT det, dep FROM holds WHERE ok UNION SELECT det, det FROM holds")
def g08_closures_of_cover(spark, sf_dir):
    """The canonical cover implies the same."""
    cover = algebra.canonical_cover(_discovered(spark, sf_dir))
    return _rows(spark, {frozenset([a]): algebra.closure([a], cover) for a in SCHEMA})


@query(f"WITH {DENORMALISED} " + " UNION ALL ".join(f"SELECT '{a}' AS key FROM d HAVING count(DISTINCT {a}) = count(*)" for a in SCHEMA))
def g07_candidate_keys(spark, sf_dir):
    keys = algebra.candidate_keys(SCHEMA, _discovered(spark, sf_dir))
    return spark.createDataFrame([("+".join(sorted(k)),) for k in keys], "key string")


@query(f"WITH {DENORMALISED} " + " UNION ALL ".join(f"SELECT '{a}' AS key FROM d HAVING count(DISTINCT {a}) = count(*)" for a in SCHEMA))
def g23_key_by_dependencies(spark, sf_dir):
    return spark.createDataFrame([("+".join(sorted(algebra.key_by_dependencies(SCHEMA, _discovered(spark, sf_dir)))),)], "key string")


SUBSET = ["o_custkey", "c_name", "c_nationkey", "n_regionkey"]


@query(f"WITH {DENORMALISED}{PAIRS_HOLD} SELECT det, dep FROM holds WHERE ok AND det IN {tuple(SUBSET)} AND dep IN {tuple(SUBSET)}")
def g12_projected(spark, sf_dir):
    """G12, C01."""
    return _rows(spark, algebra.projected(_discovered(spark, sf_dir), SUBSET))


@query(f"WITH {DENORMALISED}{PAIRS_HOLD} SELECT det, dep FROM holds WHERE ok AND det = 'o_custkey'")
def g18_with_foreign_key(spark, sf_dir):
    """What the foreign key determines."""
    return _rows(spark, algebra.with_foreign_key(_discovered(spark, sf_dir), "o_custkey"))


APPROXIMATE = ["c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
SUBSETS = [s for n in range(1, 5) for s in combinations(sorted(APPROXIMATE), n)]


@query("WITH u(name, cols, u) AS (" + " UNION ALL ".join(f"SELECT '{'+'.join(s)}', {list(s)}, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM customer)) / count(*) FROM customer" for s in SUBSETS) + ") SELECT name AS key FROM u WHERE u >= 0.9 AND NOT EXISTS (SELECT 1 FROM u v WHERE v.u >= 0.9 AND len(v.cols) < len(u.cols) AND list_has_all(u.cols, v.cols))")
def g24_approximate_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = c.count()
    keys = algebra.approximate_keys([frozenset(APPROXIMATE)], lambda key: c.select(*sorted(key)).distinct().count() / n, 0.9)
    return spark.createDataFrame([("+".join(sorted(k)),) for k in keys], "key string")


@query("SELECT 'customer' AS relation, 'FK' AS det, unnest(['c_acctbal', 'c_mktsegment', 'c_name']) AS dep")
def g15_binary_dependencies(spark, sf_dir):
    columns = ["FK", *(c for c in table(spark, sf_dir, "customer").columns if c not in ("c_custkey", "c_nationkey"))]
    return _rows(spark, algebra.binary_dependencies(columns)).select(F.lit("customer").alias("relation"), "det", "dep")


@query(f"""{ANCESTORS}, s AS (SELECT c_mktsegment AS col, 'n' || c_nationkey AS class, CAST(count(*) AS DOUBLE) AS score FROM customer GROUP BY 1, 2 UNION ALL SELECT c_mktsegment, 'r' || n_regionkey, CAST(count(*) AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
near AS (SELECT s.col, s.class, arg_min(u.score, depth) AS upper FROM s JOIN up ON child = s.class JOIN s u ON u.col = s.col AND u.class = ancestor GROUP BY 1, 2) SELECT col, class, round(score + 0.5 * coalesce(upper, 0), 6) AS score FROM s LEFT JOIN near USING (col, class)""")
def h13_corrected_scores(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    one = lambda p, k: both.groupBy(F.col("c_mktsegment").alias("col"), F.concat(F.lit(p), F.col(k).cast("string")).alias("class")).agg(F.count("*").cast("double").alias("score"))
    return graph.corrected_scores(one("n", "c_nationkey").unionByName(one("r", "n_regionkey")), _hierarchy(spark, sf_dir))


HEADER_PAIRS = """named AS (SELECT DISTINCT least(a.p_name, b.p_name) AS l, greatest(a.p_name, b.p_name) AS r FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_name <> b.p_name),
dis AS (SELECT DISTINCT a.p_name AS l, b.p_name AS r FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name < b.p_name), left_ AS (SELECT l, r FROM named EXCEPT SELECT l, r FROM dis), both_ AS (SELECT l, r FROM left_ UNION SELECT r, l FROM left_)"""


@query(f"WITH RECURSIVE {HEADER_PAIRS}, reach(a, b) AS (SELECT l, r FROM both_ UNION SELECT a, r FROM reach JOIN both_ ON b = l) SELECT a AS header, min(least(a, b)) AS cluster FROM reach GROUP BY a UNION ALL SELECT '-', '-'")
def h09_header_synonyms(spark, sf_dir):
    """Names of parts of one type and size, unless some brand has both; a last row stands for no header."""
    p = table(spark, sf_dir, "part")
    edges = graph.paired(p, "p_name", ["p_type", "p_size"])
    columns = p.select(F.col("p_brand").alias("table_id"), F.col("p_name").alias("header"))
    found = graph.header_synonyms(edges, graph.disjoint_headers(columns))
    return found.unionByName(spark.createDataFrame([("-", "-")], "header string, cluster string"))


PAGE_CLUSTERS = r"""seg AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS path, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)"""


@query(f"""WITH {QUERY_PARTS}, {PAGE_CLUSTERS}, s AS (SELECT page_id, coalesce((SELECT string_agg(header, '+' ORDER BY header) FROM named n WHERE n.page_id = seg.page_id), '') AS schema, len(list_filter(string_split(path, '/'), lambda x: x <> '')) || ':' AS c, title FROM seg)
SELECT split_part(c, ':', 1) AS cluster, schema, title AS row, count(DISTINCT page_id) AS n_tables FROM s GROUP BY 1, 2, 3""")
def l02_clustered_rows(spark, sf_dir):
    """Titles of pages as rows, parameters of their URLs as schemas, clusters by path length."""
    pages = table(spark, sf_dir, "pages")
    heads = context.uri_query_parts(pages).groupBy(F.col("page_id").alias("p")).agg(F.array_join(F.array_sort(F.collect_list("header")), "+").alias("schema"))
    rows = pages.select(F.col("page_id").alias("table_id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("row"))
    schemas = pages.join(heads, F.col("page_id") == F.col("p"), "left").select(F.col("page_id").alias("table_id"), F.coalesce("schema", F.lit("")).alias("schema"))
    clusters = h14_url_clusters(spark, sf_dir).select(F.col("page_id").alias("table_id"), F.split("cluster", ":")[0].alias("cluster"))
    return stitching.clustered_rows(rows, schemas, clusters)


@query(f"WITH {COLUMN_ROWS}, t AS (SELECT table_id, bool_or(header = 'ECONOMY') AS e FROM columns GROUP BY 1) SELECT table_id, CASE WHEN e THEN (SELECT min(table_id) FROM t WHERE e) ELSE table_id END AS entity FROM t")
def l07_entity_groups(spark, sf_dir):
    """Tables that share one column describe one type."""
    c = _columns(spark, sf_dir)
    return stitching.entity_groups(matching.label_matches(c.where("header = 'ECONOMY'")), c)


@query("SELECT trim(regexp_replace(p_name || ' (' || p_type || ')', '\\([^)]*\\)', '', 'g')) AS v, min(p_partkey) AS id FROM part GROUP BY 1")
def l12_class_extract(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kb = p.select(F.col("p_partkey").alias("id"), F.lit("Part").alias("class"), F.expr("stack(2, 'name', concat(p_name, ' (', p_type, ')'), 'type', p_type) as (property, value)"))
    return knowledge.class_extract(kb, "Part", "name")


@query("SELECT o_orderkey AS id, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus <> 'P'")
def l15_annotated_rows(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kb = c.select(F.col("c_custkey").alias("id"), F.expr("stack(3, 'segment', c_mktsegment, 'nation', cast(c_nationkey as string), 'name', c_name) as (property, value)"))
    links = o.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("l"), F.col("o_custkey").alias("r"))
    return stitching.annotated(o.select(F.col("o_orderkey").alias("id")), links, kb, ["segment", "nation"])


@query("""WITH c AS (SELECT c_nationkey AS col_id, c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1, 2) SELECT col_id, name FROM (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY n DESC, name DESC) AS k FROM c) WHERE k = 1""")
def l18_renamed_by_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return selection.renamed_by_sources(c.select(F.col("c_nationkey").alias("col_id"), F.col("c_custkey").alias("source")), c.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("source")))


@query(f"WITH {COLUMN_ROWS} SELECT table_id, min(col_id) AS col_id FROM columns WHERE NOT is_context GROUP BY 1")
def l20_by_subject(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return selection.by_subject(c, c.where("not is_context").groupBy("table_id").agg(F.min("col_id").alias("col_id")))


@query(f"WITH {COLUMN_ROWS}, {LABELS} SELECT l, r FROM labels_ WHERE l_table <= 10 AND r_table <= 10")
def l22_edges_of_tables(spark, sf_dir):
    c = _columns(spark, sf_dir)
    own = c.select("table_id").distinct().where("table_id <= 10")
    keys = c.groupBy("table_id").agg(F.collect_list("col_id").alias("cols"))
    return selection.of_tables(own, matching.label_matches(c, True), c, keys)[0].select("l", "r")


@query("""WITH k AS (SELECT *, round(c_acctbal, -2) AS bal, min(c_custkey) OVER (PARTITION BY round(c_acctbal, -2)) AS entity FROM customer)
SELECT entity, min(bal) AS bal, min(c_nationkey) AS c_nationkey, count(*) AS n_rows FROM k GROUP BY 1 HAVING min(c_nationkey) = max(c_nationkey)""")
def l09_deduplicated(spark, sf_dir):
    """Customers of a rounded balance are one entity, unless they have two nations."""
    c = table(spark, sf_dir, "customer").withColumn("bal", F.round("c_acctbal", -2))
    return duplicates.deduplicated(c, "c_custkey", [["bal"]], ["bal", "c_nationkey"])


@query(f"""{COMPONENTS}, comp AS (SELECT a AS node, min(least(a, b)) AS c FROM reach GROUP BY a)
SELECT coalesce(c, n_nationkey) AS cluster, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS names, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), '|' ORDER BY CAST(n_regionkey AS VARCHAR)) AS regions, count(*) AS n FROM nation LEFT JOIN comp ON node = n_nationkey GROUP BY 1""")
def l11_fused(spark, sf_dir):
    found = duplicates.fused(table(spark, sf_dir, "nation"), _pairs(spark, sf_dir), "n_nationkey", ["n_name", "n_regionkey"])
    return found.select("cluster", F.array_join("n_name", "|").alias("names"), F.array_join("n_regionkey", "|").alias("regions"), "n")


@query("SELECT c_mktsegment AS property, count(*) AS n, count(*) FILTER (abs(c_acctbal) / 10000 > 0.9) AS correct FROM customer GROUP BY 1")
def m11_slot_filling(spark, sf_dir):
    return evaluation.slot_filling(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("property"), (F.abs("c_acctbal") / 10000).alias("score")))


@query(f"WITH {PAIRS} SELECT DISTINCT a.s_suppkey AS l, b.s_suppkey AS r FROM edges JOIN supplier a ON a.s_nationkey = l JOIN supplier b ON b.s_nationkey = r")
def m13_expanded_edges(spark, sf_dir):
    return evaluation.expanded(_pairs(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("target"), F.col("s_suppkey").alias("source")))


@query(f"{COMPONENTS} SELECT a AS id, min(least(a, b)) AS cluster FROM reach GROUP BY a")
def m14_gold_of_edges(spark, sf_dir):
    return evaluation.edges_to_gold(_pairs(spark, sf_dir).withColumn("score", F.lit(1.0)))


@query("SELECT o_orderpriority AS f, c_mktsegment AS g, CAST(sum(o_orderkey) AS BIGINT) AS weight FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def m09_provenance_overlap(spark, sf_dir):
    """M09, M17."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return evaluation.provenance_overlap(o.select(F.col("o_orderpriority").alias("id"), F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("weight")), c.select(F.col("c_mktsegment").alias("id"), F.col("c_custkey").alias("source")))


@query(f"""{COMPONENTS}, found AS (SELECT a AS id, min(least(a, b)) AS cluster FROM reach GROUP BY a), gold AS (SELECT n_nationkey AS id, n_regionkey AS cluster FROM nation), x AS (SELECT coalesce(sum(n * (n - 1) / 2), 0)::DOUBLE AS correct FROM (SELECT count(*) AS n FROM gold g JOIN found f USING (id) GROUP BY g.cluster, f.cluster)), y AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS created FROM (SELECT count(*) AS n FROM found GROUP BY cluster)), z AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS total FROM (SELECT count(*) AS n FROM gold GROUP BY cluster))
SELECT correct, created, total, round(correct / created, 6) AS "precision", round(correct / total, 6) AS recall, round(2 * (correct / created) * (correct / total) / (correct / created + correct / total), 6) AS f1 FROM x, y, z""")
def m10_table_scores(spark, sf_dir):
    gold = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("cluster"))
    return evaluation.table_scores(_pairs(spark, sf_dir), gold)


@query("""WITH ref AS (SELECT o_orderstatus AS t, o_orderkey AS row, o_orderpriority AS v FROM orders), ext AS (SELECT o_orderstatus AS e, o_orderkey AS row, CASE WHEN o_totalprice > 250000 THEN '?' ELSE o_orderpriority END AS w FROM orders WHERE o_totalprice > 50000),
c AS (SELECT t, CAST(count(*) AS DOUBLE) AS correct FROM ref JOIN ext USING (row) WHERE t = e AND v = w GROUP BY 1), s AS (SELECT t, correct, (SELECT count(*) FROM ext WHERE e = t) AS created, (SELECT count(*) FROM ref r WHERE r.t = c.t) AS total FROM c)
SELECT t AS "table", t AS extracted, correct, created, total, round(correct / created, 6) AS "precision", round(correct / total, 6) AS recall, round(2 * (correct / created) * (correct / total) / (correct / created + correct / total), 6) AS f1 FROM s""")
def m06_relation_scores(spark, sf_dir):
    """States as relations, whose dear orders have a wrong cell and whose cheap ones are missing."""
    o = table(spark, sf_dir, "orders")
    ref = o.select(F.col("o_orderstatus").alias("table"), F.col("o_orderkey").alias("row"), F.lit("p").alias("column"), F.col("o_orderpriority").alias("v"))
    wrong = F.when(F.col("o_totalprice") > 250000, "?").otherwise(F.col("o_orderpriority"))
    ext = o.where("o_totalprice > 50000").select(F.col("o_orderstatus").alias("table"), F.col("o_orderkey").alias("row"), F.lit("p").alias("column"), wrong.alias("v"))
    return evaluation.relation_scores(ref, ext)


@query(f"WITH {PAIRS}, g AS (SELECT n_nationkey AS id, n_regionkey AS c, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS w FROM nation) SELECT round(sum(CASE WHEN a.c = b.c THEN a.w * b.w ELSE 0 END) / sum(a.w * b.w), 6) AS \"precision\" FROM edges JOIN g a ON l = a.id JOIN g b ON r = b.id")
def m02_weighted_pairwise(spark, sf_dir):
    w = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("weight"))
    gold = table(spark, sf_dir, "nation").join(w, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("cluster"), F.coalesce("weight", F.lit(0)).alias("weight"))
    return evaluation.weighted_pairwise(gold, _pairs(spark, sf_dir))
