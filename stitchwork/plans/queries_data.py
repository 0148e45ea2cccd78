"""Queries: context, cleaning, filters, keys, joins, profiles, ranking, dependencies, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.catalog import query
from stitchwork.functions import similarity, text
from stitchwork.operators import context, dependencies, profile, ranking, relational, stitching
from stitchwork.plans import dependencies as algebra


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PATH_PARTS = r"""
parts AS (
  SELECT page_id, i - 1 AS pos, replace(seg[i], '-', ' ') AS value
  FROM (SELECT page_id, string_split(p, '/') AS seg FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS p FROM pages) WHERE p <> ''),
       LATERAL (SELECT unnest(range(1, len(seg) + 1)) AS i) WHERE seg[i] <> '')
"""


@query(f"WITH {PATH_PARTS} SELECT page_id, CAST(pos AS INT) AS pos, 'uri ' || pos AS header, value FROM parts")
def b01_uri_path_parts(spark, sf_dir):
    return context.uri_path_parts(table(spark, sf_dir, "pages"))


QUERY_PARTS = r"""
q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
params AS (SELECT page_id, i, regexp_replace(split_part(s[i], '=', 1), '\W', '', 'g') AS name, url_decode(split_part(s[i], '=', 2)) AS value
  FROM (SELECT page_id, string_split(q, '&') AS s FROM q WHERE q <> ''), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
numbered AS (SELECT page_id, name, value, row_number() OVER (PARTITION BY page_id, name ORDER BY i) AS k FROM params WHERE name <> ''),
named AS (SELECT page_id, 'uri ' || name || CASE WHEN k > 1 THEN '[' || k || ']' ELSE '' END AS header, value FROM numbered)
"""


@query(f"WITH {QUERY_PARTS} SELECT page_id, header, value FROM named")
def b03_uri_query_parts(spark, sf_dir):
    return context.uri_query_parts(table(spark, sf_dir, "pages"))


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS page_title, nullif(replace(coalesce(s[1], ''), '-', ' '), '') AS uri_0, nullif(replace(coalesce(s[2], ''), '-', ' '), '') AS uri_1
FROM (SELECT *, string_split(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/') AS s FROM pages)
""")
def b05_context_wide(spark, sf_dir):
    return context.context_wide(table(spark, sf_dir, "pages"), 2, F.regexp_extract("html", "<title>([^<]*)", 1))


@query(f"""WITH {PATH_PARTS}, {QUERY_PARTS}
SELECT header, count(DISTINCT page_id) AS n_tables FROM (SELECT page_id, 'uri ' || pos AS header FROM parts UNION ALL SELECT page_id, header FROM named) GROUP BY header""")
def b06_context_headers(spark, sf_dir):
    return context.context_headers(table(spark, sf_dir, "pages"))


@query(f"""WITH {PATH_PARTS}, sized AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS length FROM parts)
SELECT length, CAST(pos AS INT) AS pos, value, count(DISTINCT page_id) AS support FROM sized GROUP BY ALL""")
def h14_item_support(spark, sf_dir):
    return context.item_support(table(spark, sf_dir, "pages"))


@query(f"""WITH {PATH_PARTS}, sized AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS length FROM parts),
support AS (SELECT length, pos, value, count(*) AS s FROM sized GROUP BY ALL),
best AS (SELECT length, pos, max(s) AS top FROM support GROUP BY ALL),
n AS (SELECT length, count(DISTINCT page_id) AS n FROM sized GROUP BY ALL),
split AS (SELECT length, pos FROM (SELECT length, pos, top, n, row_number() OVER (PARTITION BY length ORDER BY top DESC, pos) AS k FROM best JOIN n USING (length)) WHERE k = 1 AND top >= 0.1 * n)
SELECT page_id, sized.length || ':' || coalesce(max(CASE WHEN split.pos IS NOT NULL THEN split.pos || '=' || value END), '*') AS cluster
FROM sized LEFT JOIN split ON sized.length = split.length AND sized.pos = split.pos GROUP BY page_id, sized.length
UNION ALL SELECT page_id, '0:*' FROM pages WHERE page_id NOT IN (SELECT page_id FROM parts)""")
def h14_url_clusters(spark, sf_dir):
    return context.url_clusters(table(spark, sf_dir, "pages"))


def _labels(spark, sf_dir):
    """Customer names as cells with brackets, numbers and file names."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 5
    value = F.when(k == 0, F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).when(k == 1, F.concat(F.col("c_nationkey").cast("string"), F.lit(". "), "c_name")).when(k == 2, F.concat("c_name", F.lit(" page-1.html")))
    return c.select("c_custkey", value.otherwise(F.concat("c_name", F.lit(" [x] 12.5% (a) (b)"))).alias("v"))


LABELS = """
cells AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ' (' || c_mktsegment || ')' WHEN 1 THEN c_nationkey || '. ' || c_name
  WHEN 2 THEN c_name || ' page-1.html' ELSE c_name || ' [x] 12.5% (a) (b)' END AS v FROM customer)
"""


@query(rf"""WITH {LABELS} SELECT c_custkey, CASE WHEN regexp_matches(v, '^.*\(([^)]*)\).*$') THEN regexp_extract(v, '^.*\(([^)]*)\).*$', 1) END AS disambiguation,
nullif(trim(regexp_replace(v, '\([^)]*\)', '', 'g')), '') AS rest FROM cells""")
def b07_brackets(spark, sf_dir):
    return _labels(spark, sf_dir).select("c_custkey", text.bracket_text(F.col("v")).alias("disambiguation"), text.without_brackets(F.col("v")).alias("rest"))


@query(rf"""WITH {LABELS} SELECT c_custkey, CASE WHEN regexp_matches(v, '^(\d*)\. (.+)$') THEN TRY_CAST(regexp_extract(v, '^(\d*)\. (.+)$', 1) AS DOUBLE) END AS number,
CASE WHEN regexp_matches(v, '^(\d*)\. (.+)$') THEN regexp_extract(v, '^(\d*)\. (.+)$', 2) ELSE v END AS rest FROM cells""")
def b08_numbering(spark, sf_dir):
    return _labels(spark, sf_dir).select("c_custkey", text.leading_number(F.col("v")).alias("number"), text.without_leading_number(F.col("v")).alias("rest"))


@query(rf"""WITH {LABELS}, bare AS (SELECT c_custkey, trim(regexp_replace(v, '\([^)]*\)|\[[^\]]*\]', '', 'g')) AS v FROM cells),
one AS (SELECT c_custkey, CASE WHEN regexp_matches(v, '^(\d*)\. (.+)$') THEN regexp_extract(v, '^(\d*)\. (.+)$', 2) ELSE v END AS v FROM bare)
SELECT c_custkey, nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(v), '[.!?]+', ' ', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '') AS v FROM one""")
def b10_normalised_cells(spark, sf_dir):
    return _labels(spark, sf_dir).select("c_custkey", text.normalised_cell(F.col("v")).alias("v"))


@query(r"""SELECT item_id, array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), '|') AS tokens FROM benchmark""")
def b12_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.tokens(F.col("text")), "|").alias("tokens"))


@query(rf"""WITH {LABELS} SELECT c_custkey, nullif(trim(regexp_replace(v, '[\w,-]+\.(html|htm|asp|php)$', '', 'g')), '') AS no_file,
nullif(trim(regexp_replace(v, '(?i)[+-]?(0x[0-9a-f]+(\.[0-9a-f]*)?(p[+-]?\d+)?|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)%?', '', 'g')), '') AS no_number,
CASE WHEN length(v) >= 24 THEN v END AS long_enough, regexp_matches(v, '^[\w,-]+\.\w+$') AS is_file FROM cells""")
def b13_value_filters(spark, sf_dir):
    v = F.col("v")
    return _labels(spark, sf_dir).select("c_custkey", text.without_filename(v).alias("no_file"), text.without_numbers(v).alias("no_number"), text.at_least(v, 24).alias("long_enough"), text.looks_like_filename(v).alias("is_file"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_orderkey IS NOT NULL AND trim(CAST(o_orderpriority AS VARCHAR)) <> '') OR (o_custkey IS NOT NULL AND trim(o_orderstatus) <> '')""")
def c07_enforce_keys(spark, sf_dir):
    return relational.enforce_keys(table(spark, sf_dir, "orders"), [["o_orderkey", "o_orderpriority"], ["o_custkey", "o_orderstatus"]]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 10)")
def c08_large_groups(spark, sf_dir):
    return relational.large_groups(table(spark, sf_dir, "customer"), ["c_nationkey"], 10).select("c_custkey", "c_nationkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def c09_keep_first(spark, sf_dir):
    return relational.keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


SPARSE = "sparse AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority FROM orders)"


def _sparse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"))


@query(f"WITH {SPARSE} SELECT o_custkey, min(status) AS status, min(priority) AS priority FROM sparse GROUP BY 1 HAVING coalesce(min(status) = max(status), true) AND coalesce(min(priority) = max(priority), true)")
def c09_replace_nulls(spark, sf_dir):
    return relational.replace_nulls(_sparse(spark, sf_dir), ["o_custkey"], ["status", "priority"])


@query(f"WITH {SPARSE} SELECT o_custkey, coalesce(array_to_string(list_sort(list(DISTINCT status) FILTER (status IS NOT NULL)), '|'), '') AS statuses, coalesce(array_to_string(list_sort(list(DISTINCT priority) FILTER (priority IS NOT NULL)), '|'), '') AS priorities FROM sparse GROUP BY 1")
def c09_create_set(spark, sf_dir):
    sets = relational.create_set(_sparse(spark, sf_dir), ["o_custkey"], ["status", "priority"])
    return sets.select("o_custkey", F.array_join("status", "|").alias("statuses"), F.array_join("priority", "|").alias("priorities"))


@query(f"WITH {SPARSE} SELECT * FROM sparse WHERE o_custkey IN (SELECT o_custkey FROM sparse GROUP BY 1 HAVING min(status) <> max(status))")
def c09_conflicts(spark, sf_dir):
    return relational.conflicts(_sparse(spark, sf_dir), ["o_custkey"], ["status"])


@query(f"WITH {SPARSE} SELECT DISTINCT * FROM sparse")
def c09_keep_both(spark, sf_dir):
    return relational.keep_both(_sparse(spark, sf_dir), ["o_custkey"], ["status", "priority"])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def c10_exact_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT min(c_custkey) AS c_custkey, c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment")
def c11_distinct_but_key(spark, sf_dir):
    return relational.distinct_but(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")


@query("""SELECT 'o_totalprice' AS "column", count(DISTINCT o_custkey) AS n_entities, round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 6) AS density FROM orders WHERE o_totalprice IS NOT NULL
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_custkey), round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 6) FROM orders WHERE o_orderstatus IS NOT NULL""")
def c17_relation_density(spark, sf_dir):
    return relational.dense_relations(table(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice", "o_orderstatus"], table(spark, sf_dir, "customer").count(), 0.0)


@query("SELECT n_nationkey, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def d01_join_on(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return relational.join_on(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey"), nation, ["n_nationkey"])


@query("SELECT c_name, c_mktsegment, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def d02_entity_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return relational.entity_join(c, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "c_custkey", "o_custkey")


def _pairs(spark, sf_dir):
    """Customers and suppliers of a nation, as an edge list of nations by market segment."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("l"), ((F.col("c_custkey") * 7) % 25).cast("int").alias("r")).where("l != r").distinct()


PAIRS = "edges AS (SELECT DISTINCT c_nationkey AS l, CAST(c_custkey * 7 % 25 AS INT) AS r FROM customer WHERE c_nationkey <> c_custkey * 7 % 25)"


@query(f"WITH {PAIRS}, src AS (SELECT n_nationkey AS id, n_regionkey AS src FROM nation) SELECT l, r FROM edges JOIN src a ON l = a.id JOIN src b ON r = b.id WHERE a.src <> b.src")
def d04_disjoint_provenance(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("col_id"), F.array("n_regionkey").alias("sources"))
    return relational.disjoint_provenance(_pairs(spark, sf_dir), n)


@query(f"WITH {PAIRS} SELECT r AS l, l AS r FROM edges EXCEPT SELECT l, r FROM edges")
def d08_missing_edges(spark, sf_dir):
    e = _pairs(spark, sf_dir)
    return relational.missing_edges(e.select(F.col("r").alias("l"), F.col("l").alias("r")), e)


@query(f"WITH {PAIRS}, cls AS (SELECT n_nationkey AS id, n_regionkey AS c FROM nation) SELECT l, r FROM edges JOIN cls a ON l = a.id JOIN cls b ON r = b.id WHERE a.c = b.c")
def d11_same_class(spark, sf_dir):
    return relational.same_class(_pairs(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("class")))


CUSTOMER = ["c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count({c}) / count(*), 6) AS density, round((count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT))) / count(*), 6) AS uniqueness FROM customer" for c in CUSTOMER))
def e04_column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "customer"), CUSTOMER)


@query(" UNION ALL ".join(f"SELECT '{a}+{b}' AS columns, round((SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM customer)) / count(*), 6) AS uniqueness FROM customer" for a, b in (("c_nationkey", "c_mktsegment"), ("c_name", "c_nationkey"))))
def e05_set_uniqueness(spark, sf_dir):
    return profile.set_uniqueness(table(spark, sf_dir, "customer"), [["c_nationkey", "c_mktsegment"], ["c_name", "c_nationkey"]])


@query("SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS conflict_rate, round(count(*) / sum(n), 6) AS uniqueness FROM (SELECT count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL OR l_suppkey IS NOT NULL GROUP BY l_partkey, l_suppkey)")
def e07_conflict_rate(spark, sf_dir):
    return profile.conflict_rate(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT))) / count(*), 6) AS uniqueness FROM customer" for c in CUSTOMER) + ") WHERE uniqueness >= 0.1")
def e08_blocking_keys(spark, sf_dir):
    return profile.blocking_keys(profile.column_profile(table(spark, sf_dir, "customer"), CUSTOMER))


@query("SELECT round(round(value / 1000, 6), 1) AS bin, count(*) AS n FROM events GROUP BY 1")
def e10_similarity_histogram(spark, sf_dir):
    return profile.similarity_histogram(table(spark, sf_dir, "events").select(F.round(F.col("value") / 1000, 6).alias("s")), "s")


@query("SELECT c_mktsegment AS class, round(1 - n / max(n) OVER (), 6) AS weight FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def e11_class_weight(spark, sf_dir):
    return profile.size_weights(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n")))


@query("SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1")
def e12_date_ranges(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query("SELECT l_suppkey % 7 AS l_table, l_partkey % 7 AS r_table, count(*) AS n FROM lineitem GROUP BY 1, 2")
def e13_table_linkage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("l_table"), (F.col("l_partkey") % 7).alias("r_table")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_tuples, count(DISTINCT o_custkey) AS n_keys, round(count(*) / count(DISTINCT o_custkey), 6) AS per_key FROM orders WHERE o_custkey IS NOT NULL")
def e15_cardinality(spark, sf_dir):
    return profile.cardinality(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_nationkey, c_mktsegment, w FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY w DESC, c_mktsegment) AS k FROM (SELECT c_nationkey, c_mktsegment, sum(c_custkey) AS w FROM customer GROUP BY 1, 2)) WHERE k = 1")
def e20_weighted_mode(spark, sf_dir):
    return profile.weighted_mode(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey")


@query("SELECT c_nationkey AS \"table\", c_mktsegment AS class, score, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_mktsegment) AS k FROM (SELECT c_nationkey, c_mktsegment, sum(c_custkey) AS score, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) >= 2)) WHERE k = 1")
def e17_class_argmax(spark, sf_dir):
    return profile.class_argmax(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("table"), F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("score")), 2)


@query("SELECT o_custkey, o_orderkey, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def f03_top_k(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


SCORES = """scored AS (SELECT l_partkey % 20 AS l, l_suppkey % 20 AS r, CAST(l_returnflag = 'N' AS INT) AS l_table, 1 AS r_table, round(sum(l_quantity) + (l_partkey % 20) / 100.0 + (l_suppkey % 20) / 10000.0, 6) AS score FROM lineitem GROUP BY 1, 2, 3)"""


def _scored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    l, r = F.col("l_partkey") % 20, F.col("l_suppkey") % 20  # noqa: E741
    g = li.groupBy(l.alias("l"), r.alias("r"), (F.col("l_returnflag") == "N").cast("int").alias("l_table")).agg(F.sum("l_quantity").alias("q"))
    return g.select("l", "r", "l_table", F.lit(1).alias("r_table"), F.round(F.col("q") + F.col("l") / 100 + F.col("r") / 10000, 6).alias("score"))


@query(f"""WITH {SCORES} SELECT l, r, l_table, r_table, score FROM (SELECT *, row_number() OVER (PARTITION BY l_table, r_table, l ORDER BY score DESC, r) AS a, row_number() OVER (PARTITION BY l_table, r_table, r ORDER BY score DESC, l) AS b FROM scored) WHERE a = 1 AND b = 1""")
def f04_mutual_best(spark, sf_dir):
    return ranking.mutual_best(_scored(spark, sf_dir))


@query()
def f06_maximum_matching(spark, sf_dir):
    return ranking.maximum_matching(_scored(spark, sf_dir), ["l_table", "r_table"])


@query("""WITH b AS (SELECT o_custkey AS block, count(*) AS size FROM orders GROUP BY 1), k AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM b)
SELECT block, size FROM b WHERE size <= (SELECT size FROM k WHERE i = greatest(0, CAST(floor(n * 0.9) AS BIGINT) - 1))""")
def f08_block_filter(spark, sf_dir):
    return ranking.block_filter(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("block")).agg(F.count("*").alias("size")), 0.9)


DENORMALISED = "d AS (SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_nationkey, c_mktsegment, n_name, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _denormalised(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "o_custkey", "o_orderstatus", "c_name", "c_nationkey", "c_mktsegment", "n_name", "n_regionkey")


def g3_sql(det: str, deps: list[str], source: str) -> str:
    one = lambda a: f"SELECT '{det}' AS det, '{a}' AS dep, round(sum(m) / sum(n), 6) AS rate FROM (SELECT max(n) AS m, sum(n) AS n FROM (SELECT {det}, {a}, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {det})"
    return " UNION ALL ".join(map(one, deps))


DEPENDANTS = ["o_orderstatus", "c_name", "c_nationkey", "c_mktsegment", "n_name", "n_regionkey"]


@query(f"WITH {DENORMALISED} " + g3_sql("o_custkey", DEPENDANTS, "d"))
def g13_approximate_dependencies(spark, sf_dir):
    return dependencies.g3_rates(_denormalised(spark, sf_dir), [(["o_custkey"], DEPENDANTS)])


LATTICE = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query(" UNION ALL ".join(f"SELECT '{a}+{b}' AS det, '{c}' AS dep, round(sum(m) / sum(n), 6) AS rate FROM (SELECT max(n) AS m, sum(n) AS n FROM (SELECT {a}, {b}, {c}, count(*) AS n FROM orders GROUP BY ALL) GROUP BY {a}, {b})" for a, b, c in (("o_orderstatus", "o_orderpriority", "o_custkey"), ("o_orderstatus", "o_custkey", "o_orderpriority"), ("o_orderpriority", "o_custkey", "o_orderstatus"))))
def g13_lattice_level2(spark, sf_dir):
    return dependencies.lattice_level(table(spark, sf_dir, "orders"), LATTICE, 2)


@query("SELECT 'l_partkey' AS det, 'l_suppkey' AS dep, round(sum(CASE WHEN v <= 1 THEN n ELSE 0 END) / sum(n), 6) AS rate FROM (SELECT count(*) AS n, count(DISTINCT l_suppkey) + max(CAST(l_suppkey IS NULL AS INT)) AS v FROM lineitem GROUP BY l_partkey)")
def g14_approximation_rate(spark, sf_dir):
    return dependencies.approximation_rate(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)")
def g14_violating_rows(spark, sf_dir):
    return dependencies.violating_rows(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


FDS = algebra.make([("o_orderkey".split(), ["o_custkey", "o_orderstatus"]), (["o_custkey"], ["c_name", "c_nationkey", "c_mktsegment"]), (["c_nationkey"], ["n_name", "n_regionkey"])])
SCHEMA = ["o_orderkey", "o_custkey", "o_orderstatus", "c_name", "c_nationkey", "c_mktsegment", "n_name", "n_regionkey"]
FRAGMENTS = f"""WITH {DENORMALISED} SELECT 'c_nationkey' AS relation, c_nationkey || '|' || n_name || '|' || n_regionkey AS row FROM (SELECT DISTINCT c_nationkey, n_name, n_regionkey FROM d)
UNION ALL SELECT 'o_custkey', c_mktsegment || '|' || c_name || '|' || c_nationkey || '|' || o_custkey FROM (SELECT DISTINCT c_mktsegment, c_name, c_nationkey, o_custkey FROM d)
UNION ALL SELECT 'o_orderkey', o_custkey || '|' || o_orderkey || '|' || o_orderstatus FROM (SELECT DISTINCT o_custkey, o_orderkey, o_orderstatus FROM d)"""


def _fragments(df: DataFrame, relations: list) -> DataFrame:
    out = None
    for name, part in sorted(dependencies.decomposed(df, relations).items()):
        one = part.select(F.lit(name).alias("relation"), F.concat_ws("|", *(F.col(c).cast("string") for c in sorted(part.columns))).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


@query(FRAGMENTS)
def g22_bcnf_fragments(spark, sf_dir):
    return _fragments(_denormalised(spark, sf_dir), algebra.boyce_codd_normal_form(SCHEMA, FDS))


@query(FRAGMENTS)
def g21_3nf_fragments(spark, sf_dir):
    return _fragments(_denormalised(spark, sf_dir), algebra.third_normal_form(SCHEMA, FDS))


@query(f"""WITH {DENORMALISED} SELECT 'o_orderkey' AS relation, c_mktsegment || '|' || c_name || '|' || c_nationkey || '|' || n_name || '|' || n_regionkey || '|' || o_custkey || '|' || o_orderkey || '|' || o_orderstatus AS row FROM d""")
def g20_2nf_fragments(spark, sf_dir):
    return _fragments(_denormalised(spark, sf_dir), algebra.second_normal_form(SCHEMA, FDS))


@query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1")
def l16_dependency_relation(spark, sf_dir):
    return dependencies.dependency_relation(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_suppkey"])


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice = c_acctbal THEN 1.0 WHEN o_totalprice * c_acctbal <= 0 THEN 0.0 ELSE least(abs(o_totalprice), abs(c_acctbal)) / greatest(abs(o_totalprice), abs(c_acctbal)) END, 6) AS deviation,
round(1 - levenshtein(o_orderpriority, c_mktsegment) / greatest(length(o_orderpriority), length(c_mktsegment)), 6) AS edits,
round((CAST(day(o_orderdate) = 1 AS INT) + 3 * CAST(month(o_orderdate) = 1 AS INT) + 5 * greatest(0, 1 - abs(year(o_orderdate) - 1995) / 10)) / 9, 6) AS dates FROM orders JOIN customer ON o_custkey = c_custkey""")
def j09_similarities(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.lit("1995-01-01").cast("timestamp")
    return both.select(
        "o_orderkey", F.round(similarity.deviation(F.col("o_totalprice"), F.col("c_acctbal")), 6).alias("deviation"),
        F.round(similarity.edit_similarity(F.col("o_orderpriority"), F.col("c_mktsegment")), 6).alias("edits"), F.round(similarity.date_similarity(F.col("o_orderdate"), day), 6).alias("dates"),
    )


@query("""SELECT 'orders' AS "table", '{"o_orderkey":"' || o_orderkey || '"}' AS key, 'o_orderstatus' AS attribute, o_orderstatus AS value FROM orders WHERE o_orderstatus IS NOT NULL
UNION ALL SELECT 'orders', '{"o_orderkey":"' || o_orderkey || '"}', 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL""")
def l13_tuple_listing(spark, sf_dir):
    return stitching.tuple_listing(table(spark, sf_dir, "orders"), "orders", ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IS NOT NULL OR o_orderpriority IS NOT NULL")
def l14_tuples_to_wide(spark, sf_dir):
    return stitching.tuples_to_wide(l13_tuple_listing(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])
