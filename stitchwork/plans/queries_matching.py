"""Queries: graphs, vectors, matching, stitching, entities, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.catalog import query
from stitchwork.functions import text
from stitchwork.operators import context, evaluation, graph, matching, stitching, vectors
from stitchwork.plans.queries_data import PAIRS, _pairs, table

COLUMNS = {"customer": ["c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_name", "s_nationkey"], "nation": ["n_name", "n_nationkey", "n_regionkey"], "orders": ["o_custkey", "o_orderstatus"]}
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "orders": "o_orderkey"}


def _cells(spark, sf_dir) -> DataFrame:
    out = None
    for i, (name, columns) in enumerate(COLUMNS.items()):
        one = matching.to_cells(table(spark, sf_dir, name), i, KEYS[name], columns, name)
        out = one if out is None else out.unionByName(one)
    return out


CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT {i} AS table_id, CAST({KEYS[t]} AS VARCHAR) AS row_id, '{t}.{c}' AS col_id, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for i, (t, cs) in enumerate(COLUMNS.items()) for c in cs) + ")"
OVERLAP = "vals AS (SELECT DISTINCT table_id, col_id, v FROM cells), overlap AS (SELECT a.col_id AS l, b.col_id AS r, a.table_id AS l_table, b.table_id AS r_table, CAST(count(*) AS DOUBLE) AS score FROM vals a JOIN vals b ON a.v = b.v AND a.table_id < b.table_id GROUP BY ALL)"


@query(f"WITH {CELLS}, {OVERLAP} SELECT * FROM overlap")
def i01_value_overlap(spark, sf_dir):
    return matching.value_overlap(_cells(spark, sf_dir))


@query(f"""WITH {CELLS}, {OVERLAP} SELECT l, r, l_table, r_table, score FROM (SELECT *, row_number() OVER (PARTITION BY l_table, r_table, l ORDER BY score DESC, r) AS a, row_number() OVER (PARTITION BY l_table, r_table, r ORDER BY score DESC, l) AS b FROM overlap) WHERE a = 1 AND b = 1""")
def i01_value_matches(spark, sf_dir):
    return matching.value_matches(_cells(spark, sf_dir))


TOKENS = r"tok AS (SELECT col_id AS owner, unnest(list_filter(string_split(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM cells)"
VECTORS = """cnt AS (SELECT owner, token, count(*) AS n FROM tok GROUP BY ALL), tf AS (SELECT owner, token, n / count(*) OVER (PARTITION BY owner) AS w FROM cnt),
idf AS (SELECT token, ln(CAST((SELECT count(DISTINCT owner) FROM cnt) AS DOUBLE) / count(*)) AS idf FROM cnt GROUP BY 1),
vec AS (SELECT owner, token, w * idf AS w FROM tf JOIN idf USING (token)), norm AS (SELECT owner, sqrt(sum(w * w)) AS s FROM vec GROUP BY 1)"""


@query(f"""WITH {CELLS}, {TOKENS}, {VECTORS}, dots AS (SELECT a.owner AS l, b.owner AS r, sum(a.w * b.w) AS dot FROM vec a JOIN vec b ON a.token = b.token AND a.owner < b.owner GROUP BY ALL),
o AS (SELECT DISTINCT col_id, table_id FROM cells)
SELECT l, r, x.table_id AS l_table, y.table_id AS r_table, round(dot / (p.s * q.s), 6) AS score FROM dots JOIN norm p ON l = p.owner JOIN norm q ON r = q.owner JOIN o x ON l = x.col_id JOIN o y ON r = y.col_id
WHERE x.table_id <> y.table_id AND p.s * q.s > 0 AND dot / (p.s * q.s) >= 0.2""")
def j05_tfidf_cosine_join(spark, sf_dir):
    return matching.value_cosine(_cells(spark, sf_dir), 0.2).withColumn("score", F.round("score", 6))


@query(f"WITH {CELLS}, {TOKENS}, cnt AS (SELECT owner, token, count(*) AS n FROM tok GROUP BY ALL) SELECT owner, token, round(n / count(*) OVER (PARTITION BY owner), 6) AS weight FROM cnt")
def j01_tf_vectors(spark, sf_dir):
    return vectors.vectors(_tokens(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def _tokens(spark, sf_dir) -> DataFrame:
    return _cells(spark, sf_dir).select(F.col("col_id").alias("owner"), F.explode(text.tokens(F.col("v"))).alias("token"))


@query(f"WITH {CELLS}, {TOKENS}, {VECTORS} SELECT token, (SELECT count(*) FROM cnt c WHERE c.token = idf.token) AS df, round(idf, 6) AS idf FROM idf")
def j04_idf(spark, sf_dir):
    return vectors.idf(vectors.vectors(_tokens(spark, sf_dir))).select("token", "df", F.round("idf", 6).alias("idf"))


SETS = "s AS (SELECT DISTINCT owner, token FROM tok), size AS (SELECT owner, count(*) AS n FROM s GROUP BY 1), common AS (SELECT a.owner AS l, b.owner AS r, count(*) AS c FROM s a JOIN s b ON a.token = b.token AND a.owner <> b.owner GROUP BY ALL)"


@query(f"WITH {CELLS}, {TOKENS}, {SETS} SELECT l, r, round(c / (p.n + q.n - c), 6) AS score FROM common JOIN size p ON l = p.owner JOIN size q ON r = q.owner")
def j05_jaccard_columns(spark, sf_dir):
    v = vectors.vectors(_tokens(spark, sf_dir), "binary")
    return vectors.jaccard(v, v).withColumn("score", F.round("score", 6))


@query(f"WITH {CELLS}, {TOKENS}, {SETS} SELECT l, r, round(c / least(p.n, q.n), 6) AS score FROM common JOIN size p ON l = p.owner JOIN size q ON r = q.owner")
def j05_containment_columns(spark, sf_dir):
    v = vectors.vectors(_tokens(spark, sf_dir), "binary")
    return vectors.containment(v, v).withColumn("score", F.round("score", 6))


@query(f"""WITH {CELLS}, {TOKENS}, {VECTORS}, dots AS (SELECT a.owner AS l, b.owner AS r, sum(a.w * b.w) AS dot FROM tf a JOIN tf b ON a.token = b.token AND a.owner <> b.owner GROUP BY ALL), sq AS (SELECT owner, sum(w * w) AS s FROM tf GROUP BY 1)
SELECT l, r, round(greatest(dot / p.s, dot / q.s), 6) AS score FROM dots JOIN sq p ON l = p.owner JOIN sq q ON r = q.owner""")
def j06_generalised_containment(spark, sf_dir):
    v = vectors.vectors(_tokens(spark, sf_dir))
    return vectors.generalised_containment(v, v).withColumn("score", F.round("score", 6))


@query(f"WITH {CELLS}, {TOKENS} SELECT token, count(DISTINCT owner) AS size FROM tok GROUP BY 1")
def j11_block_sizes(spark, sf_dir):
    return vectors.block_sizes(vectors.vectors(_tokens(spark, sf_dir)))


@query(f"""WITH {CELLS}, {TOKENS}, {VECTORS}, {OVERLAP}, nrm AS (SELECT owner, sqrt(sum(w * w)) AS s FROM tf GROUP BY 1)
SELECT l, r, round(sum(a.w * b.w) / (p.s * q.s), 6) AS score FROM overlap JOIN tf a ON l = a.owner JOIN tf b ON r = b.owner AND a.token = b.token JOIN nrm p ON l = p.owner JOIN nrm q ON r = q.owner GROUP BY l, r, p.s, q.s HAVING sum(a.w * b.w) / (p.s * q.s) >= 0.01""")
def i48_rescored_edges(spark, sf_dir):
    edges = matching.value_overlap(_cells(spark, sf_dir))
    return vectors.rescored(edges, vectors.vectors(_tokens(spark, sf_dir)), 0.01).withColumn("score", F.round("score", 6))


COLUMN_ROWS = """heads AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS table_id, p_type AS header FROM part UNION SELECT CAST(substr(p_brand, 7) AS INT), 'Disambiguation of ' || p_type FROM part WHERE p_size = 50 UNION SELECT CAST(substr(p_brand, 7) AS INT), 'uri 0' FROM part),
columns AS (SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY header) - 1 AS INT) AS ord, header, header LIKE 'uri %' OR header LIKE 'Disambiguation of %' AS is_context, table_id || '~Col' || (row_number() OVER (PARTITION BY table_id ORDER BY header) - 1) AS col_id FROM heads)"""


def _columns(spark, sf_dir) -> DataFrame:
    """Brands as tables, whose columns are the types of their parts, one for the site, and disambiguations of types with large parts."""
    p = table(spark, sf_dir, "part").withColumn("table_id", F.expr("cast(substr(p_brand, 7) as int)"))
    heads = p.select("table_id", F.col("p_type").alias("header")).union(p.where("p_size = 50").select("table_id", F.concat(F.lit("Disambiguation of "), "p_type"))).union(p.select("table_id", F.lit("uri 0"))).distinct()
    ord_ = F.row_number().over(Window.partitionBy("table_id").orderBy("header")) - 1
    return heads.withColumn("ord", ord_).withColumn("is_context", context.is_context(F.col("header"))).withColumn("col_id", F.concat(F.col("table_id").cast("string"), F.lit("~Col"), F.col("ord").cast("string")))


LABELS = "labels_ AS (SELECT a.col_id AS l, b.col_id AS r, a.table_id AS l_table, b.table_id AS r_table, a.header AS h, a.is_context AS ctx FROM columns a JOIN columns b ON a.header = b.header AND a.table_id < b.table_id)"


@query(f"WITH {COLUMN_ROWS} SELECT a.col_id AS l, b.col_id AS r, a.table_id AS l_table, b.table_id AS r_table, 1.0::DOUBLE AS score FROM columns a JOIN columns b ON a.header = b.header AND a.table_id < b.table_id WHERE NOT a.is_context AND NOT b.is_context")
def i04_label_matches(spark, sf_dir):
    return matching.label_matches(_columns(spark, sf_dir))


@query(f"WITH {COLUMN_ROWS}, s AS (SELECT *, string_agg(coalesce(header, ''), '+' ORDER BY ord) OVER (PARTITION BY table_id) AS schema FROM columns) SELECT a.col_id AS l, b.col_id AS r, a.table_id AS l_table, b.table_id AS r_table, 1.0::DOUBLE AS score FROM s a JOIN s b ON a.schema = b.schema AND a.ord = b.ord AND a.header IS NOT DISTINCT FROM b.header AND a.table_id < b.table_id".replace("string_agg(coalesce(header, ''), '+' ORDER BY ord) OVER (PARTITION BY table_id)", "(SELECT string_agg(coalesce(c.header, ''), '+' ORDER BY c.ord) FROM columns c WHERE c.table_id = columns.table_id)"))
def i20_union_matches(spark, sf_dir):
    return matching.union_matches(_columns(spark, sf_dir))


@query(f"WITH {COLUMN_ROWS} SELECT a.header AS l, b.header AS r, count(*) AS n FROM columns a JOIN columns b ON a.table_id = b.table_id AND a.header < b.header GROUP BY 1, 2")
def h15_disjoint_headers(spark, sf_dir):
    return graph.disjoint_headers(_columns(spark, sf_dir).select("table_id", "header"))


@query(f"WITH {COLUMN_ROWS} SELECT table_id, string_agg(coalesce(header, ''), '+' ORDER BY ord) AS schema, coalesce(string_agg(coalesce(header, ''), '+' ORDER BY ord) FILTER (NOT is_context), '') AS own_schema FROM columns GROUP BY 1")
def b23_schema_strings(spark, sf_dir):
    return stitching.schema_strings(_columns(spark, sf_dir))


@query(f"WITH {COLUMN_ROWS}, s AS (SELECT table_id, string_agg(coalesce(header, ''), '+' ORDER BY ord) AS schema FROM columns GROUP BY 1) SELECT schema, count(*) AS n FROM s GROUP BY 1")
def e09_schema_frequency(spark, sf_dir):
    return stitching.schema_strings(_columns(spark, sf_dir)).groupBy("schema").agg(F.count("*").alias("n"))


MAPPED = """m AS (SELECT l_table, r_table, count(DISTINCT l) FILTER (h NOT LIKE 'Disambiguation of %') AS both_, count(DISTINCT l) FILTER (NOT ctx) AS own FROM labels_ GROUP BY 1, 2),
n AS (SELECT table_id, count(*) FILTER (header NOT LIKE 'Disambiguation of %') AS both_, count(*) FILTER (NOT is_context) AS own FROM columns GROUP BY 1)"""


@query(f"WITH {COLUMN_ROWS}, {LABELS}, {MAPPED} SELECT l_table, r_table FROM m JOIN n a ON l_table = a.table_id JOIN n b ON r_table = b.table_id WHERE m.both_ = a.both_ AND m.both_ = b.both_")
def i12_fully_mapped(spark, sf_dir):
    return matching.fully_mapped(matching.label_matches(_columns(spark, sf_dir), True), _columns(spark, sf_dir))


@query(f"WITH {COLUMN_ROWS}, {LABELS}, {MAPPED} SELECT l_table, r_table FROM m JOIN n a ON l_table = a.table_id JOIN n b ON r_table = b.table_id WHERE m.own = a.own OR m.own = b.own")
def i12_one_mapped(spark, sf_dir):
    return matching.fully_mapped(matching.label_matches(_columns(spark, sf_dir), True), _columns(spark, sf_dir), "one")


@query(f"WITH {COLUMN_ROWS}, {LABELS}, {MAPPED} SELECT l_table, r_table FROM m WHERE own >= 1")
def i12_any_mapped(spark, sf_dir):
    return matching.fully_mapped(matching.label_matches(_columns(spark, sf_dir), True), _columns(spark, sf_dir), "any")


@query(f"WITH {COLUMN_ROWS}, {LABELS} SELECT l_table, r_table, count(DISTINCT l) FILTER (h NOT LIKE 'uri %') AS score FROM labels_ GROUP BY 1, 2 HAVING bool_or(h = 'ECONOMY') AND count(DISTINCT l) FILTER (h NOT LIKE 'uri %') > 1")
def i12_most_columns_mapped(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return matching.most_columns_mapped(matching.label_matches(c, True), c, "ECONOMY")


@query(f"""WITH {COLUMN_ROWS}, {LABELS}, k AS (SELECT table_id, list(col_id) AS cols FROM columns WHERE header IN ('ECONOMY', 'Disambiguation of ECONOMY') GROUP BY 1), mm AS (SELECT l_table, r_table, list(l) AS ls, list(r) AS rs FROM labels_ WHERE NOT ctx GROUP BY 1, 2)
SELECT l_table, r_table, coalesce(list_has_all(ls, a.cols), false) AS left_key, coalesce(list_has_all(rs, b.cols), false) AS right_key FROM mm LEFT JOIN k a ON a.table_id = l_table LEFT JOIN k b ON b.table_id = r_table""")
def i12_key_mapped(spark, sf_dir):
    c = _columns(spark, sf_dir)
    keys = c.where("header in ('ECONOMY', 'Disambiguation of ECONOMY')").groupBy("table_id").agg(F.collect_list("col_id").alias("cols"))
    return matching.key_mapped(matching.label_matches(c), keys)


@query("SELECT s_suppkey AS l, c_custkey AS r FROM supplier JOIN customer ON s_nationkey = c_nationkey AND round(s_acctbal, -3) = round(c_acctbal, -3)")
def i07_duplicates_by_key(spark, sf_dir):
    bal = lambda t, c: table(spark, sf_dir, t).withColumn("bal", F.round(c, -3))
    return matching.duplicates_by_key(bal("supplier", "s_acctbal"), bal("customer", "c_acctbal"), "s_suppkey", "c_custkey", [("s_nationkey", "c_nationkey"), ("bal", "bal")])


@query("""WITH p AS (SELECT s_nationkey AS a, c_nationkey AS b, CAST(round(s_acctbal, -3) AS BIGINT) AS x, CAST(round(c_acctbal, -3) AS BIGINT) AS y FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT * FROM (SELECT 's_nationkey' AS l, 'c_nationkey' AS r, round(avg(CAST(a = b AS DOUBLE)), 6) AS score FROM p UNION ALL SELECT 's_nationkey', 'bal', round(avg(CAST(a = y AS DOUBLE)), 6) FROM p
UNION ALL SELECT 'bal', 'c_nationkey', round(avg(CAST(x = b AS DOUBLE)), 6) FROM p UNION ALL SELECT 'bal', 'bal', round(avg(CAST(x = y AS DOUBLE)), 6) FROM p) WHERE score > 0""")
def i08_schema_votes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("bal", F.round("s_acctbal", -3).cast("long"))
    c = table(spark, sf_dir, "customer").withColumn("bal", F.round("c_acctbal", -3).cast("long"))
    return matching.schema_votes_by_key(s, c, [("s_nationkey", "c_nationkey")], ["s_nationkey", "bal"], ["c_nationkey", "bal"])


@query(r"""WITH a AS (SELECT DISTINCT item_id, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM benchmark)
SELECT a.item_id AS l, b.item_id AS r, count(*) AS common FROM a JOIN a b USING (token) WHERE token <> '' GROUP BY ALL""")
def d15_token_blocks(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return matching.token_blocks(b, b, "item_id", "item_id", text.tokens(F.col("text")), text.tokens(F.col("text")))


@query("SELECT c_custkey, array_to_string(list_sort([coalesce(CAST(c_nationkey AS VARCHAR), 'null'), coalesce(c_mktsegment, 'null'), coalesce(c_name, 'null')]), '~') AS key FROM customer")
def i38_full_row_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", matching.full_row_key(["c_nationkey", "c_mktsegment", "c_name"]).alias("key"))


@query(f"WITH {CELLS}, a AS (SELECT DISTINCT row_id AS l, v FROM cells WHERE table_id = 1), b AS (SELECT row_id AS r, col_id, v FROM cells WHERE table_id = 2) SELECT l, r, count(DISTINCT col_id) AS score FROM a JOIN b USING (v) GROUP BY ALL")
def i37_cell_overlap(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return matching.cell_overlap(c.where("table_id = 1"), c.where("table_id = 2"))


ENTITIES = r"""web AS (SELECT DISTINCT 'part' AS class, p_name || ' ' || p_type AS label FROM part), kb AS (SELECT DISTINCT 'part' AS class, p_type || ' ' || p_name || ' ' || lower(p_brand) AS label FROM part),
tok(side, class, id, tokens) AS (SELECT 'w', class, label, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) FROM web
  UNION ALL SELECT 'k', class, label, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) FROM kb),
uniq AS (SELECT side, class, tokens, min(id) AS id FROM tok GROUP BY ALL),
sc AS (SELECT w.class, w.id AS l, k.id AS r, round(len(list_intersect(w.tokens, k.tokens)) / (len(w.tokens) + len(k.tokens) - len(list_intersect(w.tokens, k.tokens))), 6) AS score FROM uniq w JOIN uniq k ON w.class = k.class AND w.side = 'w' AND k.side = 'k')"""


def _entities(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    side = lambda *cols: p.select(F.concat_ws(" ", *cols).alias("label")).distinct().select(F.col("label").alias("id"), F.lit("part").alias("class"), "label")
    return side("p_name", "p_type"), side("p_type", "p_name", F.lower("p_brand"))


@query(f"""WITH {ENTITIES}, first AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS a, row_number() OVER (PARTITION BY r ORDER BY score DESC, l) AS b FROM sc WHERE score >= 0.6) SELECT l, r, class, score FROM first WHERE a = 1 AND b = 1""")
def i24_linked_entities(spark, sf_dir):
    return matching.linked_entities(*_entities(spark, sf_dir))


@query("""WITH q AS (SELECT DISTINCT p_name AS id FROM part), qt AS (SELECT DISTINCT id, unnest(string_split(id, ' ')) AS t FROM q), it AS (SELECT id AS i, replace(t, 'i', 'y') AS o FROM qt),
q2 AS (SELECT id || 's' AS q, unnest(list_distinct(string_split(id || 's', ' '))) AS token, id || 's' AS ql FROM q), i2 AS (SELECT replace(id, 'i', 'y') AS i, unnest(list_distinct(string_split(replace(id, 'i', 'y'), ' '))) AS other FROM q),
met AS (SELECT q, i, min(levenshtein(token, other)) AS edits, count(DISTINCT token) AS common FROM q2 JOIN i2 ON levenshtein(token, other) <= 2 GROUP BY 1, 2)
SELECT q, i, common, CAST(edits AS INT) AS edits, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY common DESC, edits, levenshtein(q, i), i) AS rank FROM met) WHERE rank <= 5""")
def a17_fuzzy_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    kind = lambda n: names.select(n.alias("id"), n.alias("label"), F.lit("part").alias("class"))
    return matching.fuzzy_lookup(kind(F.concat(F.col("p_name"), F.lit("s"))), kind(F.replace("p_name", F.lit("i"), F.lit("y"))), 2, 5)


COMPONENTS = f"WITH RECURSIVE {PAIRS}, both_ AS (SELECT l, r FROM edges UNION SELECT r, l FROM edges), reach(a, b) AS (SELECT l, r FROM both_ UNION SELECT a, r FROM reach JOIN both_ ON b = l)"


@query(f"{COMPONENTS} SELECT a AS node, min(least(a, b)) AS component FROM reach GROUP BY a")
def h04_components(spark, sf_dir):
    return graph.components(_pairs(spark, sf_dir))


@query(f"{COMPONENTS} SELECT a AS l, b AS r FROM reach WHERE a <> b")
def h05_closure_pairs(spark, sf_dir):
    return graph.closure_pairs(_pairs(spark, sf_dir))


@query(f"{COMPONENTS} SELECT a AS l, b AS r FROM reach WHERE a < b EXCEPT SELECT least(l, r), greatest(l, r) FROM edges")
def h06_missing_transitive_edges(spark, sf_dir):
    return graph.missing_transitive_edges(_pairs(spark, sf_dir))


HIERARCHY = "h AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"
ANCESTORS = f"WITH RECURSIVE {HIERARCHY}, up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM h UNION ALL SELECT up.child, h.parent, depth + 1 FROM up JOIN h ON ancestor = h.child)"


def _hierarchy(spark, sf_dir) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    return n.unionByName(table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))


@query(f"{ANCESTORS} SELECT * FROM up")
def h11_superclasses(spark, sf_dir):
    return graph.superclasses(_hierarchy(spark, sf_dir))


@query(f"""{ANCESTORS}, s AS (SELECT c_mktsegment AS col, 'n' || c_nationkey AS class, CAST(count(*) AS DOUBLE) AS score FROM customer GROUP BY 1, 2)
SELECT col, class, round(sum(score), 6) AS score FROM (SELECT * FROM s UNION ALL SELECT col, ancestor, score FROM s JOIN up ON class = child) GROUP BY 1, 2""")
def h12_propagated_scores(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("col"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("class")).agg(F.count("*").cast("double").alias("score"))
    return graph.propagated_scores(scores, _hierarchy(spark, sf_dir))


@query()
def h10_refined_edges(spark, sf_dir):
    c = _columns(spark, sf_dir)
    labels = matching.label_matches(c, True)
    wrong = c.where("table_id = 1 and ord = 0").select(F.col("col_id").alias("l")).join(c.where("table_id = 2 and ord = 1").select(F.col("col_id").alias("r")), F.lit(True))
    return graph.refined(labels.select("l", "r").unionByName(wrong), c, graph.disjoint_headers(c.select("table_id", "header")))


@query("SELECT 'customer' AS source_table, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier")
def l01_union_tables(spark, sf_dir):
    tables = {"customer": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))}
    return stitching.union_tables(tables)["name+nation"]


@query("""SELECT name, min(nation) AS nation, min(segment) AS segment FROM (SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR), NULL FROM supplier)
GROUP BY 1 HAVING coalesce(min(nation) = max(nation), true) AND coalesce(min(segment) = max(segment), true)""")
def l03_stitched(spark, sf_dir):
    mapping = {"customer": {"c_name": "name", "c_nationkey": "nation", "c_mktsegment": "segment"}, "supplier": {"s_name": "name", "s_nationkey": "nation"}}
    return stitching.stitched({t: table(spark, sf_dir, t) for t in mapping}, mapping, ["name"])


@query("SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, substr(sha256(c_mktsegment || chr(31) || c_nationkey), 1, 16) AS pk FROM customer WHERE trim(c_mktsegment) <> '' AND c_nationkey IS NOT NULL")
def l08_entity_table(spark, sf_dir):
    return stitching.entity_table([table(spark, sf_dir, "customer")], ["c_mktsegment", "c_nationkey"])


@query("SELECT c_custkey, substr(sha256(c_mktsegment || chr(31) || c_nationkey), 1, 16) AS fk FROM customer WHERE trim(c_mktsegment) <> '' AND c_nationkey IS NOT NULL")
def l10_foreign_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return stitching.with_foreign_key(c, stitching.entity_table([c], ["c_mktsegment", "c_nationkey"]), ["c_mktsegment", "c_nationkey"])


@query(f"""{COMPONENTS}, comp AS (SELECT a AS node, min(least(a, b)) AS c FROM reach GROUP BY a),
placed AS (SELECT n_nationkey AS i, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS v, coalesce(c, n_nationkey) AS entity FROM nation LEFT JOIN comp ON node = n_nationkey)
SELECT entity, arg_min(v, i) FILTER (v IS NOT NULL) AS name, count(*) AS n_rows FROM placed GROUP BY 1""")
def l09_merged_entities(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).alias("name"))
    return stitching.merged_entities(n, _pairs(spark, sf_dir), "n_nationkey", ["name"])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey / 2 ELSE o_custkey END AS o_custkey FROM orders".replace("o_custkey / 2", "o_custkey // 2"))
def l11_rewritten_keys(spark, sf_dir):
    even = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old"), F.expr("c_custkey div 2").alias("new"))
    ids = even.unionByName(table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("old"), F.expr("o_custkey div 2").alias("new"))).distinct()
    return stitching.rewritten_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


def _clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), ((F.col("c_nationkey") + (F.col("c_custkey") % 13 == 0).cast("int")) % 20).alias("cluster"))


CLUSTERS = "gold AS (SELECT c_custkey AS id, c_nationkey AS cluster FROM customer), found AS (SELECT c_custkey AS id, (c_nationkey + CAST(c_custkey % 13 = 0 AS INT)) % 20 AS cluster FROM customer WHERE c_acctbal > 0)"


@query(f"""WITH {CLUSTERS}, x AS (SELECT coalesce(sum(n * (n - 1) / 2), 0)::DOUBLE AS correct FROM (SELECT count(*) AS n FROM gold g JOIN found f USING (id) GROUP BY g.cluster, f.cluster)), y AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS created FROM (SELECT count(*) AS n FROM found GROUP BY cluster)), z AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS total FROM (SELECT count(*) AS n FROM gold GROUP BY cluster))
SELECT correct, created, total, round(correct / created, 6) AS "precision", round(correct / total, 6) AS recall, round(2 * (correct / created) * (correct / total) / (correct / created + correct / total), 6) AS f1 FROM x, y, z""")
def m02_pairwise(spark, sf_dir):
    return evaluation.pairwise(*_clusters(spark, sf_dir))


@query(f"WITH {CLUSTERS} SELECT g.cluster AS g, f.cluster AS f, count(*) AS common FROM gold g JOIN found f USING (id) GROUP BY 1, 2")
def m03_overlaps(spark, sf_dir):
    return evaluation.overlaps(*_clusters(spark, sf_dir))


@query(f"""WITH {CLUSTERS}, r AS (SELECT g.cluster, count(*) AS n, count(DISTINCT f.cluster) + sum(CAST(f.cluster IS NULL AS INT)) AS p FROM gold g LEFT JOIN found f USING (id) GROUP BY 1), q AS (SELECT f.cluster, count(*) AS n, count(DISTINCT g.cluster) + sum(CAST(g.cluster IS NULL AS INT)) AS p FROM found f LEFT JOIN gold g USING (id) GROUP BY 1)
SELECT (SELECT round(sum(n - p) / sum(n - 1), 6) FROM r) AS muc_recall, (SELECT round(sum(n - p) / sum(n - 1), 6) FROM q) AS muc_precision""")
def m05_muc(spark, sf_dir):
    return evaluation.muc(*_clusters(spark, sf_dir))


CLASSES = """counts AS (SELECT class, sum(CAST(g IS NOT DISTINCT FROM class AND f IS NOT DISTINCT FROM class AS INT)) AS correct, sum(CAST(f IS NOT DISTINCT FROM class AS INT)) AS created, sum(CAST(g IS NOT DISTINCT FROM class AS INT)) AS total
FROM (SELECT DISTINCT id, g, f, class FROM (SELECT id, g.cluster AS g, f.cluster AS f, unnest([g.cluster, f.cluster]) AS class FROM gold g FULL JOIN found f USING (id)) WHERE class IS NOT NULL) GROUP BY class),
scored AS (SELECT *, coalesce(correct / nullif(created, 0), 0) AS p, coalesce(correct / nullif(total, 0), 0) AS r FROM counts)"""


@query(f"""WITH {CLUSTERS}, {CLASSES} SELECT class, correct, created, total, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM scored""")
def m07_classification(spark, sf_dir):
    gold, found = _clusters(spark, sf_dir)
    return evaluation.classification(gold.withColumnRenamed("cluster", "class"), found.withColumnRenamed("cluster", "class"))


@query(f"""WITH {CLUSTERS}, {CLASSES}, f AS (SELECT *, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM scored), m AS (SELECT sum(correct) / sum(created) AS p, sum(correct) / sum(total) AS r FROM f)
SELECT (SELECT round(2 * p * r / (p + r), 6) FROM m) AS micro_f1, round(avg(f1), 6) AS macro_f1, round(sum(f1 * total) / sum(total), 6) AS weighted_f1 FROM f""")
def m04_averages(spark, sf_dir):
    return evaluation.averages(m07_classification(spark, sf_dir).select("class", "correct", "created", "total"))


RELATIONS = """ref AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'a' ELSE 'b' END AS t, o_orderkey AS row, o_orderstatus AS v FROM orders), ext AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'x' ELSE 'y' END AS e, o_orderkey AS row, CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE o_orderstatus END AS w FROM orders),
scores AS (SELECT t AS "table", cells, round(coalesce(m, 0) / cells, 6) AS recall FROM (SELECT t, count(*) AS cells FROM ref GROUP BY 1) LEFT JOIN (SELECT t, max(c) AS m FROM (SELECT t, e, count(*) AS c FROM ref JOIN ext USING (row) WHERE v = w GROUP BY 1, 2) GROUP BY 1) USING (t))"""


def _relations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ref = o.select(F.when(k % 3 == 0, "a").otherwise("b").alias("table"), k.alias("row"), F.lit("status").alias("column"), F.col("o_orderstatus").alias("v"))
    ext = o.select(F.when(k % 5 == 0, "x").otherwise("y").alias("table"), k.alias("row"), F.lit("status").alias("column"), F.when(k % 7 == 0, "?").otherwise(F.col("o_orderstatus")).alias("v"))
    return ref, ext


@query(f"WITH {RELATIONS} SELECT * FROM scores")
def m06_containment(spark, sf_dir):
    return evaluation.containment(*_relations(spark, sf_dir))


@query(f"WITH {RELATIONS} SELECT round(avg(recall), 6) AS macro, round(sum(recall * cells) / sum(cells), 6) AS weighted FROM scores")
def m06_weighted_macro(spark, sf_dir):
    return evaluation.weighted_macro(m06_containment(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT l, r, a.n_regionkey = b.n_regionkey AS correct FROM edges JOIN nation a ON l = a.n_nationkey JOIN nation b ON r = b.n_nationkey")
def m18_edge_split(spark, sf_dir):
    return evaluation.edge_split(_pairs(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("cluster")))


@query(f"WITH {CELLS} SELECT col_id, CASE WHEN 2 * sum(CAST(lower(trim(v)) IN ('true', 'false', 'yes', 'no') AS INT)) > count(*) THEN 'boolean' WHEN 2 * sum(CAST(TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL AS INT)) > count(*) THEN 'numeric' ELSE 'string' END AS type FROM cells GROUP BY 1")
def b21_inferred_types(spark, sf_dir):
    return stitching.inferred_types(_cells(spark, sf_dir))
