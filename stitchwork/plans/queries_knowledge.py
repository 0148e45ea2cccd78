"""Queries: matching to a knowledge base, refinement of edges, determinants, blocking, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.catalog import query
from stitchwork.functions import similarity
from stitchwork.operators import duplicates, graph, knowledge, matching, selection, vectors
from stitchwork.plans.queries_data import table
from stitchwork.plans.queries_matching import CELLS, COLUMN_ROWS, LABELS, OVERLAP, TOKENS, _cells, _columns
from stitchwork.plans.queries_selection import EDGES, _edges

CLASSED = """cand AS (SELECT DISTINCT c_nationkey AS "table", c_mktsegment AS class, 'c' || c_custkey % 3 AS l, 'p' || c_custkey % 3 AS r, count(*) AS n FROM customer GROUP BY ALL)"""


def _classed(spark, sf_dir) -> DataFrame:
    """Columns c0..c2 of nations as tables, matched to properties p0..p2 of segments as classes."""
    k = (F.col("c_custkey") % 3).cast("string")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("table"), F.col("c_mktsegment").alias("class"), F.concat(F.lit("c"), k).alias("l"), F.concat(F.lit("p"), k).alias("r")).agg(F.count("*").cast("double").alias("score"))


KEYS = "keys(class, cols) AS (VALUES ('BUILDING', ['p0', 'p1']), ('BUILDING', ['p2']), ('FURNITURE', ['p0', 'p1']), ('MACHINERY', ['p1', 'p2'])), excl AS (SELECT DISTINCT c_nationkey AS \"table\", 'BUILDING' AS class, ['p2'] AS cols FROM customer WHERE c_nationkey < 12)"


def _keys(spark) -> DataFrame:
    return spark.createDataFrame([("BUILDING", ["p0", "p1"]), ("BUILDING", ["p2"]), ("FURNITURE", ["p1", "p0"]), ("MACHINERY", ["p1", "p2"])], "class string, cols array<string>")


@query(f"""WITH {CLASSED}, {KEYS}, m AS (SELECT "table", class, list(DISTINCT r) AS rs FROM cand GROUP BY ALL), p AS (SELECT m."table", m.class, rs, k.cols FROM m LEFT JOIN keys k ON k.class = m.class WHERE NOT EXISTS (SELECT 1 FROM excl x WHERE x."table" = m."table" AND x.class = m.class AND x.cols = k.cols)),
ok AS (SELECT "table", class FROM p GROUP BY ALL HAVING bool_or(cols IS NULL OR list_has_all(rs, cols))) SELECT "table", class, l, r FROM cand SEMI JOIN ok USING ("table", class)""")
def i23_keys_mapped(spark, sf_dir):
    """Classes of which a key is mapped whole."""
    excluded = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_nationkey").alias("table"), F.lit("BUILDING").alias("class"), F.array(F.lit("p2")).alias("cols")).distinct()
    return knowledge.keys_mapped(_classed(spark, sf_dir), _keys(spark), excluded).select("table", "class", "l", "r")


@query(f"""WITH {CLASSED} SELECT "table", class, l, r FROM cand SEMI JOIN (SELECT "table", class FROM cand WHERE r = 'p1') USING ("table", class)""")
def i23_label_mapped(spark, sf_dir):
    return knowledge.label_mapped(_classed(spark, sf_dir), "p1").select("table", "class", "l", "r")


@query("""WITH t AS (SELECT DISTINCT c_nationkey AS "table", c_mktsegment AS class FROM customer), inc(class1, attrs1, class2) AS (VALUES ('BUILDING', ['a'], 'FURNITURE'), ('BUILDING', ['b'], 'BUILDING'), ('MACHINERY', ['a', 'c'], 'HOUSEHOLD'))
SELECT DISTINCT x."table", class1 AS class, array_to_string(attrs1, ',') AS cols FROM inc JOIN t x ON x.class = class1 JOIN t y ON y.class = class2 AND y."table" = x."table" WHERE class1 <> class2""")
def d10_excluded_keys(spark, sf_dir):
    """D10, I27."""
    inclusions = spark.createDataFrame([("BUILDING", ["a"], "FURNITURE", ["z"]), ("BUILDING", ["b"], "BUILDING", ["y"]), ("MACHINERY", ["a", "c"], "HOUSEHOLD", ["x"])], "class1 string, attrs1 array<string>, class2 string, attrs2 array<string>")
    tables = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("table"), F.col("c_mktsegment").alias("class")).distinct()
    return knowledge.excluded_keys(inclusions, tables).withColumn("cols", F.array_join("cols", ","))


@query(f"""WITH {CLASSED}, s AS (SELECT l, class, r, sum(n) AS total FROM cand GROUP BY ALL), c AS (SELECT "table", class, l, r, total AS score FROM cand JOIN s USING (l, class, r)),
u AS (SELECT "table", class, sum(score) AS total FROM c GROUP BY ALL), t AS (SELECT "table", class, row_number() OVER (PARTITION BY "table" ORDER BY total DESC, class) AS k FROM u) SELECT "table", class, l, r, CAST(score AS DOUBLE) AS score FROM c SEMI JOIN (SELECT * FROM t WHERE k = 1) USING ("table", class)""")
def i26_consistent_matching(spark, sf_dir):
    """Scores are summed over columns of the same name."""
    clusters = spark.createDataFrame([(f"c{i}", i) for i in range(3)], "col_id string, cluster int")
    return knowledge.consistent(_classed(spark, sf_dir), clusters).select("table", "class", "l", "r", "score")


TYPED = r"""w AS (SELECT p_brand AS owner, 'string:' || unnest(string_split(p_name, ' ')) AS token FROM part), k AS (SELECT p_type AS owner, 'string:' || unnest(string_split(p_name, ' ')) AS token FROM part),
ct AS (SELECT 0 AS s, owner, token, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT 1, owner, token, count(*) FROM k GROUP BY ALL), tf AS (SELECT s, owner, token, n / count(*) OVER (PARTITION BY s, owner) AS w FROM ct),
idf AS (SELECT token, ln((SELECT count(*) FROM (SELECT DISTINCT s, owner FROM ct))::DOUBLE / count(*)) AS idf FROM ct GROUP BY 1), v AS (SELECT s, owner, token, w * idf AS w FROM tf JOIN idf USING (token)), nrm AS (SELECT s, owner, sqrt(sum(w * w)) AS x FROM v GROUP BY ALL)"""


@query(f"""WITH {TYPED} SELECT l, r, score FROM (SELECT a.owner AS l, b.owner AS r, round(sum(a.w * b.w) / (max(p.x) * max(q.x)), 6) AS score, sum(a.w * b.w) / (max(p.x) * max(q.x)) AS exact FROM v a JOIN v b ON a.token = b.token AND a.s = 0 AND b.s = 1 JOIN nrm p ON p.s = 0 AND p.owner = a.owner JOIN nrm q ON q.s = 1 AND q.owner = b.owner WHERE p.x * q.x > 0 GROUP BY 1, 2) WHERE exact >= 0.1""")
def i22_schema_matches(spark, sf_dir):
    """Brands and types of parts by the words of their names."""
    side = lambda c: table(spark, sf_dir, "part").select(F.col(c).alias("owner"), F.lit("string").alias("type"), F.col("p_name").alias("v"))
    return knowledge.schema_matches(side("p_brand"), side("p_type"), 0.1).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT o_totalprice AS x, c_acctbal AS y, o_orderpriority AS a, c_mktsegment AS b FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'price' AS l, 'balance' AS r, round(avg(CASE WHEN x = y THEN 1.0 WHEN x * y <= 0 THEN 0.0 ELSE least(abs(x), abs(y)) / greatest(abs(x), abs(y)) END), 6) AS score FROM v""")
def i25_duplicate_based(spark, sf_dir):
    """Numbers by deviation, strings by tokens; the pair of strings is below the threshold."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    links = o.select(F.col("o_orderkey").alias("l"), F.col("o_custkey").alias("r")).join(c.select(F.col("c_custkey").alias("r")), "r", "left_semi")
    long = lambda d, i, name, cols: d.select(F.col(i).alias("id"), F.inline(F.array(*(F.struct(F.lit(n).alias(name), F.col(x).cast("string").alias("v")) for n, x in cols))))
    kind = spark.createDataFrame([("price", "balance", "numeric"), ("priority", "segment", "string")], "column string, property string, type string")
    found = knowledge.duplicate_based(links, long(o, "o_orderkey", "column", [("price", "o_totalprice"), ("priority", "o_orderpriority")]), long(c, "c_custkey", "property", [("balance", "c_acctbal"), ("segment", "c_mktsegment")]), kind, 0.0001)
    return found.select("l", "r", "score")


@query("""WITH s AS (SELECT p_brand AS col_id, p_type AS class, sum(p_size) / 100.0 AS sum, count(DISTINCT p_partkey) AS mapped FROM part GROUP BY ALL), n AS (SELECT p_brand AS col_id, count(*) AS n FROM part GROUP BY 1)
SELECT col_id, class, round(sum / n, 6) AS score FROM s JOIN n USING (col_id) WHERE mapped >= 2 AND mapped / n >= 0.1 AND round(sum / n, 6) >= 0.02""")
def i32_classes_by_linking(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    links = p.select(F.col("p_brand").alias("col_id"), F.col("p_type").alias("class"), F.col("p_partkey").alias("entity"), (F.col("p_size") / 100).alias("score"))
    return matching.classes_by_linking(links, p.groupBy(F.col("p_brand").alias("col_id")).agg(F.count("*").alias("n")), 2, 0.1, 0.02)


@query("""WITH t AS (SELECT DISTINCT p_brand AS owner, CAST(substr(p_brand, 7) AS INT) % 4 AS class, unnest(string_split(p_name, ' ')) AS token FROM part), n AS (SELECT owner, count(*) AS n FROM t GROUP BY 1),
j AS (SELECT a.owner AS l, b.owner AS r, count(*) / (max(x.n) + max(y.n) - count(*)) AS score FROM t a JOIN t b ON a.token = b.token AND a.class = b.class AND a.owner < b.owner JOIN n x ON x.owner = a.owner JOIN n y ON y.owner = b.owner GROUP BY 1, 2) SELECT l, r, round(score, 6) AS score FROM j WHERE score >= 0.5""")
def i35_relation_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    columns = p.select(F.col("p_brand").alias("col_id"), (F.expr("cast(substr(p_brand, 7) as int)") % 4).cast("string").alias("class")).distinct()
    tokens = p.select(F.col("p_brand").alias("owner"), F.explode(F.split("p_name", " ")).alias("token"))
    return selection.relation_edges(columns, tokens).withColumn("score", F.round("score", 6))


@query(f"WITH {CELLS} SELECT DISTINCT col_id AS owner, row_id || '|' || CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'string' END || '|' || v AS token FROM cells WHERE table_id = 2")
def i36_foreign_key_tokens(spark, sf_dir):
    c = _cells(spark, sf_dir).where("table_id = 2")
    return matching.foreign_key_tokens(c, c.select("row_id", F.col("row_id").alias("fk")).distinct()).distinct()


@query(f"WITH {CELLS} SELECT row_id, table_id || '~' || v AS key FROM cells WHERE col_id = 'supplier.s_name'")
def i39_cell_keys(spark, sf_dir):
    return matching.cell_keys(_cells(spark, sf_dir), "supplier.s_name")


@query(rf"WITH {CELLS} SELECT DISTINCT row_id, table_id || ':' || unnest(list_filter(string_split(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM cells WHERE col_id = 'customer.c_name'")
def i40_label_tokens(spark, sf_dir):
    return matching.blocking_tokens(_cells(spark, sf_dir), "customer.c_name", prefix=True)


@query(rf"WITH {CELLS} SELECT DISTINCT row_id, unnest(list_filter(string_split(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM cells")
def i40_row_tokens(spark, sf_dir):
    return matching.blocking_tokens(_cells(spark, sf_dir))


@query(r"""WITH e AS (SELECT DISTINCT lower(c_mktsegment) || '~' || c_nationkey AS entity FROM customer) SELECT 'Customer' AS class, 'nation+segment' AS key, token, count(*) AS n FROM (SELECT DISTINCT entity, unnest(list_filter(string_split(regexp_replace(entity, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM e) GROUP BY token""")
def i41_full_key_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cells = c.select(F.col("c_custkey").alias("row_id"), F.lit("Customer").alias("class"), F.expr("stack(3, 'segment', c_mktsegment, 'nation', cast(c_nationkey as string), 'name', c_name) as (property, v)"))
    return matching.full_key_entities(cells, spark.createDataFrame([("Customer", ["segment", "nation"])], "class string, cols array<string>"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS b, o_orderstatus AS c FROM orders)
SELECT o_orderkey, CAST(CASE WHEN a IS NULL AND b IS NULL THEN 1 WHEN a IS NULL THEN CAST(b = c AS INT) ELSE coalesce(CAST(a = b AS INT), 0) END AS DOUBLE) AS score FROM s""")
def i42_context_fallback(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b = F.when(k % 3 == 0, F.col("o_orderstatus")), F.when(k % 2 == 0, F.lit("F"))
    return table(spark, sf_dir, "orders").select("o_orderkey", matching.context_fallback(a, b, F.array("o_orderstatus")).alias("score"))


@query("""WITH k1 AS (SELECT c_custkey AS r, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS l FROM customer), k2 AS (SELECT c_custkey AS r, min(c_custkey) OVER (PARTITION BY round(c_acctbal, -2)) AS l FROM customer)
SELECT l, r FROM k1 WHERE l <> r UNION SELECT l, r FROM k2 WHERE l <> r""")
def i45_within_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("bal", F.round("c_acctbal", -2))
    return duplicates.within_table(c, "c_custkey", [["c_nationkey", "c_mktsegment"], ["bal"]])


@query("""WITH p AS (SELECT n_nationkey AS l, s_suppkey AS r, n_regionkey AS a, s_nationkey AS b FROM nation JOIN supplier ON s_nationkey = n_nationkey), s AS (SELECT l, r, round((CASE WHEN a = b THEN 1.0 WHEN a * b <= 0 THEN 0.0 ELSE least(abs(a), abs(b)) / greatest(abs(a), abs(b)) END + 1.0) / 2, 6) AS score FROM p)
SELECT l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS k FROM s WHERE score >= 0.5) WHERE k = 1""")
def i45_across_tables(spark, sf_dir):
    """Nations and suppliers with the same label; a label has one nation, which the best supplier goes to."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("label"), F.col("n_regionkey").alias("x"), F.lit("same words").alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_nationkey").alias("label"), F.col("s_nationkey").alias("x"), F.lit("words same").alias("y"))
    return duplicates.across_tables(n, s, "id", "label", {"x": "numeric", "y": "string"}, 0.5).select("l", F.col("r").cast("long").alias("r"), "score")


@query("""WITH p AS (SELECT DISTINCT p_brand, p_type, p_name FROM part), t AS (SELECT p_brand || ' ' || p_name AS a, p_type || ' ' || p_name AS b FROM p), k AS (SELECT a AS l, b AS r, list_distinct(list_filter(string_split(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS y FROM t)
SELECT l, r, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS containment, round(1 - levenshtein(l, r) / greatest(length(l), length(r)), 6) AS edits FROM k""")
def i43_pair_features(spark, sf_dir):
    """I42-I44, J09 on labels of parts."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name").distinct()
    a, b = F.concat_ws(" ", "p_brand", "p_name"), F.concat_ws(" ", "p_type", "p_name")
    side = lambda x: p.select(x.alias("id"), x.alias("label")).distinct()
    return duplicates.edit_features(p.select(a.alias("l"), b.alias("r")), side(a), side(b))


@query(f"WITH {COLUMN_ROWS}, {LABELS} SELECT l, r, l_table, r_table FROM labels_ WHERE NOT ctx")
def i46_without_context_edges(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return matching.without_context_edges(matching.label_matches(c, True), c.select("col_id", "is_context")).select("l", "r", "l_table", "r_table")


@query(f"WITH {COLUMN_ROWS}, d AS (SELECT table_id, string_agg(header, '+' ORDER BY header) AS key FROM columns WHERE NOT is_context GROUP BY 1) SELECT 'd' || a.table_id AS l, 'd' || b.table_id AS r FROM d a JOIN d b ON a.key = b.key AND a.table_id < b.table_id")
def i47_determinant_matches(spark, sf_dir):
    """All columns of a table that are no context as its determinant."""
    c = _columns(spark, sf_dir)
    det = c.where("not is_context").groupBy("table_id").agg(F.collect_list("col_id").alias("cols")).withColumn("det_id", F.concat(F.lit("d"), F.col("table_id").cast("string")))
    return matching.determinant_matches(det, matching.label_matches(c))


@query(f"WITH {COLUMN_ROWS} SELECT table_id, string_agg(col_id, '+' ORDER BY col_id) AS cols FROM columns WHERE header IN ('ECONOMY', 'uri 0') GROUP BY 1 HAVING count(*) >= 2")
def i06_key_determinants(spark, sf_dir):
    """Candidate keys of at least two columns."""
    keys = _columns(spark, sf_dir).where("header in ('ECONOMY', 'uri 0')").groupBy("table_id").agg(F.collect_list("col_id").alias("cols"))
    return matching.determinants(keys, 2).select("table_id", F.array_join("cols", "+").alias("cols"))


@query(f"WITH {COLUMN_ROWS}, h AS (SELECT header FROM columns WHERE table_id = 1 AND NOT is_context) SELECT table_id, string_agg(col_id, '+' ORDER BY col_id) AS cols FROM columns WHERE header IN (SELECT header FROM h) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM h)")
def i05_propagated_determinants(spark, sf_dir):
    """The determinant of one table in all that have its columns."""
    c = _columns(spark, sf_dir)
    det = c.where("table_id = 1 and not is_context").groupBy("table_id").agg(F.collect_list("col_id").alias("cols"))
    found = matching.propagated_determinants(det, matching.label_matches(c), c.where("is_context"))
    return found.select("table_id", F.array_join("cols", "+").alias("cols"))


WRONG = "wrong AS (SELECT a.col_id AS l, b.col_id AS r, a.header AS g, b.header AS h FROM columns a JOIN columns b ON b.header = 'Disambiguation of ' || a.header AND a.table_id < b.table_id)"


def _wrong(c: DataFrame) -> DataFrame:
    """Edges from columns to disambiguations of their headers in later tables."""
    b = c.select(F.col("col_id").alias("r"), F.col("header").alias("h"), F.col("table_id").alias("r_table"))
    return c.join(b, (F.col("h") == F.concat(F.lit("Disambiguation of "), "header")) & (F.col("table_id") < F.col("r_table"))).select(F.col("col_id").alias("l"), "r", F.col("table_id").alias("l_table"), "r_table")


@query(f"WITH {COLUMN_ROWS}, {LABELS}, {WRONG}, dis AS (SELECT DISTINCT a.header AS x, b.header AS y FROM columns a JOIN columns b ON a.table_id = b.table_id AND a.header <> b.header) SELECT l, r FROM labels_ WHERE NOT ctx UNION SELECT l, r FROM wrong WHERE NOT EXISTS (SELECT 1 FROM dis WHERE x = g AND y = h)")
def i10_pairwise_refined(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return matching.pairwise_refined(_wrong(c), matching.label_matches(c), c, graph.disjoint_headers(c.select("table_id", "header")))


@query(f"WITH {COLUMN_ROWS}, {LABELS} SELECT least(l, r) AS l, greatest(l, r) AS r FROM labels_ WHERE NOT ctx")
def i11_matched(spark, sf_dir):
    """Equal headers, refined and closed; no header stands twice in a table, so that all pairs stay."""
    c = _columns(spark, sf_dir).where("not is_context")
    cells = c.select("table_id", F.lit("0").alias("row_id"), "col_id", F.col("header").alias("v"))
    return matching.matched(cells, c)


@query(f"WITH {EDGES} SELECT l, r, score FROM e WHERE score >= 3")
def c12_above_threshold(spark, sf_dir):
    return selection.above(_edges(spark, sf_dir).select("l", "r", "score"), 3.0)


@query(f"WITH {COLUMN_ROWS}, {LABELS}, b AS (SELECT l, r FROM labels_ UNION SELECT r, l FROM labels_) SELECT l AS col_id, string_agg(r, '|' ORDER BY r) AS mapped FROM b GROUP BY 1")
def i15_translated_columns(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return matching.translated(c, matching.label_matches(c, True)).select("col_id", F.array_join("mapped", "|").alias("mapped"))


@query(f"WITH {COLUMN_ROWS}, {LABELS} SELECT DISTINCT 'm' || l_table % 4 AS l, 'm' || r_table % 4 AS r FROM labels_ WHERE l_table % 4 <> r_table % 4")
def i16_projected_edges(spark, sf_dir):
    """Edges of columns carried over to four merged tables."""
    c = _columns(spark, sf_dir)
    target = c.select(F.concat(F.lit("m"), (F.col("table_id") % 4).cast("string")).alias("target"), F.col("col_id").alias("source"))
    return matching.projected(matching.label_matches(c, True), target)


@query(f"WITH {COLUMN_ROWS}, {LABELS}, g AS (SELECT a.col_id AS source, b.col_id AS generated FROM columns a JOIN columns b ON a.table_id = b.table_id AND b.header = 'uri 0' AND NOT a.is_context) SELECT DISTINCT x.generated AS l, y.generated AS r FROM labels_ JOIN g x ON x.source = l JOIN g y ON y.source = r")
def i17_generated_matches(spark, sf_dir):
    c = _columns(spark, sf_dir)
    own = c.where("not is_context").select(F.col("table_id").alias("t"), F.col("col_id").alias("source"))
    generated = c.where("header = 'uri 0'").join(own, F.col("table_id") == F.col("t")).select("source", F.lit("uri").alias("kind"), F.col("col_id").alias("generated"))
    return matching.generated_matches(matching.label_matches(c), generated)


@query(f"WITH {COLUMN_ROWS}, {LABELS}, {WRONG}, e AS (SELECT l, r FROM labels_ WHERE NOT ctx), used AS (SELECT l AS c FROM e UNION SELECT r FROM e), more AS (SELECT l, r, false AS same FROM wrong UNION SELECT l, r, true FROM labels_ WHERE ctx) SELECT l, r FROM e UNION SELECT l, r FROM more WHERE same OR (l NOT IN (SELECT c FROM used) AND r NOT IN (SELECT c FROM used))")
def i18_merged_context_edges(spark, sf_dir):
    c = _columns(spark, sf_dir)
    more = matching.label_matches(c, True).join(c.where("is_context").select(F.col("col_id").alias("l")), "l", "left_semi").select("l", "r")
    return matching.merged_context_edges(matching.label_matches(c), _wrong(c).select("l", "r").union(more), c)


@query(f"WITH {COLUMN_ROWS}, {LABELS} SELECT l, r, l_table, r_table FROM labels_ WHERE ctx AND l_table % 5 = r_table % 5")
def i19_context_edges(spark, sf_dir):
    return matching.context_edges(_columns(spark, sf_dir).withColumn("cluster", F.col("table_id") % 5))


@query(f"""WITH {CELLS}, {TOKENS}, {OVERLAP}, cnt AS (SELECT owner, token, count(*) AS n FROM tok GROUP BY ALL), tf AS (SELECT owner, token, n / count(*) OVER (PARTITION BY owner) AS w FROM cnt), nrm AS (SELECT owner, sqrt(sum(w * w)) AS s FROM tf GROUP BY 1),
num AS (SELECT col_id FROM cells GROUP BY 1 HAVING count(TRY_CAST(v AS DOUBLE)) = count(*)), again AS (SELECT l, r, round(sum(a.w * b.w) / (max(p.s) * max(q.s)), 6) AS score FROM overlap JOIN tf a ON l = a.owner JOIN tf b ON r = b.owner AND a.token = b.token JOIN nrm p ON l = p.owner JOIN nrm q ON r = q.owner WHERE l IN (SELECT col_id FROM num) GROUP BY l, r HAVING sum(a.w * b.w) / (max(p.s) * max(q.s)) >= 0.05)
SELECT l, r, score FROM again UNION ALL SELECT l, r, score FROM overlap WHERE l NOT IN (SELECT col_id FROM num)""")
def i49_foreign_key_refined(spark, sf_dir):
    """Numeric columns are scored anew, on plain tokens here; the others keep their score."""
    cells = _cells(spark, sf_dir)
    kinds = cells.groupBy("col_id").agg(F.when(F.count(F.col("v").try_cast("double")) == F.count("*"), "numeric").otherwise("string").alias("type"))
    columns = kinds.select("col_id", F.col("col_id").alias("header"), "type", F.lit(False).alias("is_context"))
    from stitchwork.plans.queries_matching import _tokens

    found = matching.foreign_key_refined(matching.value_overlap(cells), vectors.vectors(_tokens(spark, sf_dir)), columns, 0.05)
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {CLASSED}, need(class, property) AS (VALUES ('BUILDING', 'p0'), ('BUILDING', 'p1'), ('MACHINERY', 'p0'), ('MACHINERY', 'p1'), ('MACHINERY', 'p2'))
SELECT "table", class FROM (SELECT "table", class, count(DISTINCT property) AS have FROM cand JOIN need USING (class) WHERE r = property GROUP BY ALL) JOIN (SELECT class, count(*) AS n FROM need GROUP BY 1) USING (class) WHERE have = n""")
def i50_complete_tables(spark, sf_dir):
    need = spark.createDataFrame([("BUILDING", "p0"), ("BUILDING", "p1"), ("MACHINERY", "p0"), ("MACHINERY", "p1"), ("MACHINERY", "p2")], "class string, property string")
    return selection.complete_tables(_classed(spark, sf_dir).select("table", "class", F.col("r").alias("property")), need)


@query("""WITH c AS (SELECT DISTINCT p_brand || ' ' || p_name AS l, p_type || ' ' || p_name AS r, p_size > 40 AS gold FROM part), g AS (SELECT DISTINCT l, r FROM c WHERE gold), p AS (SELECT DISTINCT l, r FROM c),
k AS (SELECT l, r, list_distinct(list_filter(string_split(regexp_replace(lower(l), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(regexp_replace(lower(r), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS y FROM p)
SELECT l, r, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard, round(1 - levenshtein(l, r) / greatest(length(l), length(r)), 6) AS edits, CAST((l, r) IN (SELECT (l, r) FROM g) AS INT) AS label FROM k""")
def i51_linkage_features(spark, sf_dir):
    """I51, D20."""
    p = table(spark, sf_dir, "part")
    l, r = F.concat_ws(" ", "p_brand", "p_name").alias("l"), F.concat_ws(" ", "p_type", "p_name").alias("r")  # noqa: E741
    pairs = p.select(l, r).distinct()
    gold = p.where("p_size > 40").select(l, r).distinct()
    side = lambda x: pairs.select(F.col(x).alias("id"), F.col(x).alias("label")).distinct()
    found = knowledge.linkage_features(pairs, side("l"), side("r"), gold)
    return found.withColumn("jaccard", F.round("jaccard", 6)).withColumn("edits", F.round("edits", 6))


@query("""WITH d AS (SELECT p_partkey AS owner, unnest(string_split(p_name, ' ')) AS token FROM part), df AS (SELECT token, ln((SELECT count(DISTINCT owner) FROM d)::DOUBLE / count(DISTINCT owner)) AS idf FROM d GROUP BY 1),
q AS (SELECT DISTINCT p_name AS owner, unnest(list_append(string_split(p_name, ' '), 'unheard')) AS token FROM part), tf AS (SELECT owner, token, count(*) / (SELECT count(DISTINCT token) FROM q x WHERE x.owner = q.owner) AS w FROM q GROUP BY owner, token),
v AS (SELECT owner, token, w * coalesce(idf, 0) AS w FROM tf LEFT JOIN df USING (token)), n AS (SELECT owner, sqrt(sum(w * w)) AS s FROM v GROUP BY 1), p AS (SELECT DISTINCT a.p_name AS l, b.p_name AS r FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size),
s AS (SELECT a.owner AS l, b.owner AS r, sum(a.w * b.w) AS dot FROM v a JOIN v b USING (token) GROUP BY 1, 2) SELECT p.l, p.r, round(coalesce(dot / (x.s * y.s), 0), 6) AS score FROM p LEFT JOIN s ON s.l = p.l AND s.r = p.r JOIN n x ON x.owner = p.l JOIN n y ON y.owner = p.r""")
def j07_string_similarities(spark, sf_dir):
    """Names of parts of one type and size, by weights fixed on all parts; a word that the corpus does not have weighs 0."""
    p = table(spark, sf_dir, "part")
    corpus = vectors.TfIdf(p.select(F.col("p_partkey").alias("owner"), F.explode(F.split("p_name", " ")).alias("token")))
    named = p.select(F.col("p_name").alias("owner")).distinct().select("owner", F.explode(F.concat(F.split("owner", " "), F.array(F.lit("unheard")))).alias("token"))
    return corpus.similarities(named, named, graph.paired(p, "p_name", ["p_type", "p_size"])).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT l_orderkey AS a, l_partkey AS b, l_suppkey AS c, l_linenumber AS d FROM lineitem) SELECT a AS l, b AS r, c AS cause_l, d AS cause_r FROM e WHERE least(a % 3, b % 3) = least(c % 3, d % 3) AND greatest(a % 3, b % 3) = greatest(c % 3, d % 3)""")
def j08_causes(spark, sf_dir):
    """Keys of line items, their sources being their remainders by three."""
    li = table(spark, sf_dir, "lineitem")
    ids = None
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"):
        one = li.select(F.col(c).cast("long").alias("id"))
        ids = one if ids is None else ids.union(one)
    edges = li.select(F.col("l_orderkey").alias("l"), F.col("l_partkey").alias("r"), F.col("l_suppkey").alias("cause_l"), F.col("l_linenumber").cast("long").alias("cause_r"))
    return selection.causes(edges, ids.distinct().withColumn("source", F.col("id") % 3)).withColumn("cause_r", F.col("cause_r").cast("int"))


@query("""SELECT o_orderkey, round(CASE WHEN s >= 0.4 THEN s END, 6) AS score FROM (SELECT o_orderkey, 0.75 * (1 - levenshtein(o_orderpriority, o_orderstatus) / greatest(length(o_orderpriority), length(o_orderstatus))) + 0.25 * CAST(o_orderstatus = 'F' AS INT) + 0.25 * CAST(o_orderpriority LIKE '%LOW' AS INT) AS s FROM orders)""")
def j10_combined(spark, sf_dir):
    parts = [(similarity.edit_similarity(F.col("o_orderpriority"), F.col("o_orderstatus")), 6.0), ((F.col("o_orderstatus") == "F").cast("double"), 2.0)]
    both = [*parts[:1], (parts[1][0] + F.col("o_orderpriority").endswith("LOW").cast("double"), 2.0)]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(similarity.combined(both, 0.4), 6).alias("score"))


@query(f"WITH {COLUMN_ROWS}, {LABELS}, g AS (SELECT l, r FROM labels_ WHERE NOT ctx), m AS (SELECT 'all' AS matcher, l, r FROM labels_ UNION ALL SELECT 'labels', l, r FROM g), s AS (SELECT matcher, count(*) FILTER ((l, r) IN (SELECT (l, r) FROM g)) AS correct, count(*) AS created, (SELECT count(*) FROM g) AS total FROM m GROUP BY 1) SELECT matcher, correct, created, total, round(correct / created, 6) AS \"precision\", round(correct / total, 6) AS recall, round(2 * (correct / created) * (correct / total) / (correct / created + correct / total), 6) AS f1 FROM s")
def m16_bake_off(spark, sf_dir):
    from stitchwork.operators import evaluation

    c = _columns(spark, sf_dir)
    return evaluation.bake_off({"all": matching.label_matches(c, True), "labels": matching.label_matches(c)}, matching.label_matches(c))


@query("""WITH e AS (SELECT c_nationkey AS col_id, c_mktsegment AS class, CAST(count(*) AS DOUBLE) AS score FROM customer GROUP BY 1, 2), g AS (SELECT DISTINCT c_nationkey AS col_id, c_mktsegment AS class FROM customer WHERE c_acctbal > 5000), t AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY score DESC, class) = 1 AS top, (col_id, class) IN (SELECT (col_id, class) FROM g) AS ok FROM e),
s AS (SELECT count(*) FILTER (ok) / count(*) AS ap, count(DISTINCT col_id) FILTER (ok) / (SELECT count(DISTINCT col_id) FROM g) AS mr, count(*) FILTER (ok AND top) / count(*) FILTER (top) AS p, count(*) FILTER (ok AND top) / (SELECT count(DISTINCT col_id) FROM g) AS r FROM t)
SELECT round(ap, 6) AS all_precision, round(mr, 6) AS max_recall, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def m19_column_classes(spark, sf_dir):
    from stitchwork.operators import evaluation

    e = _edges(spark, sf_dir).select(F.col("l").alias("col_id"), F.col("r").alias("class"), "score")
    gold = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("col_id"), F.col("c_mktsegment").alias("class")).distinct()
    return evaluation.column_class_scores(e, gold)
