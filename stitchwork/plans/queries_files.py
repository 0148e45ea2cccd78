"""Queries: files that are written from a table and read by the engine's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.catalog import query
from stitchwork.operators import vectors
from stitchwork.operators.graph import folder
from stitchwork.plans.queries_data import table
from stitchwork.sources import files


def lines(df: DataFrame, *columns, sep: str = "\t") -> str:
    """The columns written as lines of text; the folder that they are in."""
    path = folder(df.sparkSession)
    df.select(F.concat_ws(sep, *columns).alias("value")).write.text(path)
    return path


def text_of(name: str):
    return F.col(name).cast("string")


NATION_CELLS = "cells AS (SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS row_id, n_nationkey, n_name FROM nation)"


@query(f"WITH {NATION_CELLS} SELECT r_name AS title, row_id, 0 AS ord, CAST(n_nationkey AS VARCHAR) AS v FROM cells JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, row_id, 1, n_name FROM cells JOIN region ON n_regionkey = r_regionkey")
def a01_json_tables(spark, sf_dir):
    """A JSON table for each region, one for each file, with its nations as rows."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))
    web = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("http://x.org/"), "r_name").alias("url"), F.col("r_name").alias("title"), F.lit("nations").alias("heading"), F.array(F.lit("key"), F.lit("name")).alias("header"), "rows")
    path = folder(spark)
    web.write.option("maxRecordsPerFile", 1).json(path)
    read = files.web_tables(spark, path)
    return files.cells(read).join(read.select("path", "title"), "path").select("title", "row_id", "ord", "v")


@query("""SELECT CAST(n AS INT) AS row_id, CAST(o AS INT) AS ord, v FROM (SELECT 0 AS n, unnest([0, 1]) AS o, unnest(['n_nationkey', 'label']) AS v
UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), 0, CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), 1, n_name || ', "of" ' || n_regionkey || chr(10) || 'end' FROM nation)""")
def a01_csv_tables(spark, sf_dir):
    """Quoted fields with commas, quotes and line feeds."""
    path = folder(spark)
    label = F.concat("n_name", F.lit(', "of" '), text_of("n_regionkey"), F.lit("\nend"))
    table(spark, sf_dir, "nation").orderBy("n_nationkey").select(text_of("n_nationkey").alias("n_nationkey"), label.alias("label")).coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return files.csv_tables(spark, path).select("row_id", "ord", "v")


@query("""WITH p AS (SELECT DISTINCT 'site/' || c_mktsegment || '/t' || c_nationkey || '.json' AS path, CAST(c_nationkey AS INT) AS d FROM customer), c AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY path) AS k FROM p)
SELECT path, d AS table_id FROM c WHERE k = 1 AND d >= 10 UNION ALL SELECT path, CAST((SELECT max(d) FROM c WHERE k = 1 AND d >= 10) + row_number() OVER (ORDER BY path) AS INT) FROM c WHERE NOT (k = 1 AND d >= 10)""")
def a02_table_ids(spark, sf_dir):
    path = F.concat(F.lit("site/"), "c_mktsegment", F.lit("/t"), text_of("c_nationkey"), F.lit(".json"))
    return files.table_ids(table(spark, sf_dir, "customer").select(path.alias("path")), 10).withColumn("table_id", F.col("table_id").cast("int"))


@query("""SELECT 'c' || c_custkey AS uri, c_name AS label, 'Customer' AS class, 'segment' AS property, c_mktsegment AS value FROM customer UNION ALL SELECT 'c' || c_custkey, c_name, 'Customer', 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 's' || s_suppkey, s_name, 'Supplier', 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def a04_knowledge_base(spark, sf_dir):
    """A CSV for each class; a property with a twin of labels is left out."""
    c, s = folder(spark), folder(spark)
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), text_of("c_custkey")).alias("URI"), F.col("c_name").alias("rdf-schema#label"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.lit("x").alias("ref"), F.lit("y").alias("ref_label"))
    customer.drop("ref_label").withColumn("ref_label", F.lit("y")).write.option("header", True).csv(c)
    table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), text_of("s_suppkey")).alias("URI"), F.col("s_name").alias("rdf-schema#label"), F.col("s_nationkey").alias("nation")).write.option("header", True).csv(s)
    return files.knowledge_base(spark, {"Customer": c, "Supplier": s}).where("property != 'ref_label'")


@query("SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation")
def a05_class_hierarchy(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = lines(n, F.concat(F.lit('"http://x.org/o/n'), text_of("n_nationkey"), F.lit('"')), F.concat(F.lit("http://x.org/o/r"), text_of("n_regionkey")))
    return files.class_hierarchy(spark, path)


@query("SELECT 'n' || n_nationkey AS class1, 'a|b' AS attrs1, 'r' || n_regionkey AS class2, 'k' AS attrs2, round(n_nationkey / 25, 6) AS score FROM nation")
def a07_inclusion_dependencies(spark, sf_dir):
    """Lines of other than five fields are left out."""
    n = table(spark, sf_dir, "nation").withColumn("more", F.explode(F.array(F.lit(None), F.lit("sixth"))))
    score = F.round(F.col("n_nationkey") / 25, 6).cast("string")
    path = lines(n, F.concat(F.lit("n"), text_of("n_nationkey")), F.lit("a,b"), F.concat(F.lit("r"), text_of("n_regionkey")), F.lit("k"), score, "more")
    found = files.inclusion_dependencies(spark, path)
    return found.select("class1", F.array_join("attrs1", "|").alias("attrs1"), "class2", F.array_join("attrs2", "|").alias("attrs2"), "score")


@query("SELECT r_name AS label, string_agg(alias, '|' ORDER BY alias) AS aliases FROM (SELECT DISTINCT r_name, unnest([n_name, 'old ' || n_name]) AS alias FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def a08_surface_forms(spark, sf_dir):
    """Aliases of a label from lines of forms and from redirects."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    forms = lines(both, "r_name", "n_name", "n_name")
    redirects = lines(both, "r_name", F.concat(F.lit("old "), "n_name"))
    return files.surface_forms(spark, forms, redirects).select("label", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT n_name AS entity, 'k' || n_nationkey || ',name' AS key, 'c1,c2' AS columns FROM nation")
def a09_definitions(spark, sf_dir):
    path = lines(table(spark, sf_dir, "nation"), "n_name", F.concat(F.lit("k"), text_of("n_nationkey"), F.lit(", name")), F.lit("[c1,c2]"))
    return files.definitions(spark, path).select("entity", F.array_join(F.col("lists")[0], ",").alias("key"), F.array_join(F.col("lists")[1], ",").alias("columns"))


@query("SELECT r_name AS cluster, n_name AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
def a10_gold_clusters(spark, sf_dir):
    """A10: written as lines of name and members, and read again."""
    members = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = folder(spark)
    files.write_clusters(members.select(F.col("r_name").alias("cluster"), F.col("n_name").alias("id")), path)
    return files.gold_clusters(spark, path)


@query("SELECT a.n_name AS l, b.n_name AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def a11_gold_pairs(spark, sf_dir):
    return files.gold_pairs(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("id")))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def a12_relation_json(spark, sf_dir):
    """A relation written as JSON and read again."""
    path, p = folder(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    files.write_relation(p, path)
    return spark.read.schema(p.schema).json(path)


@query("SELECT c_mktsegment AS what, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'all', CAST(count(*) AS VARCHAR) FROM customer")
def a14_reports(spark, sf_dir):
    """A report that a second one is appended to."""
    c, path = table(spark, sf_dir, "customer"), folder(spark)
    files.write_report(c.groupBy(F.col("c_mktsegment").alias("what")).agg(F.count("*").alias("n")), path)
    files.write_report(c.agg(F.lit("all").alias("what"), F.count("*").alias("n")), path, append=True)
    return spark.read.option("sep", "\t").schema("what string, n string").csv(path)


@query("""WITH nodes AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT n_name AS node FROM nation UNION SELECT r_name FROM region))
SELECT '*Vertices ' || count(*) AS line FROM nodes UNION ALL SELECT i || ' "' || node || '"' FROM nodes UNION ALL SELECT '*Edges' UNION ALL SELECT a.i || ' ' || b.i || ' 1.0' FROM nation JOIN region ON n_regionkey = r_regionkey JOIN nodes a ON a.node = n_name JOIN nodes b ON b.node = r_name""")
def a15_graph_file(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = folder(spark)
    files.write_graph(both.select(F.col("n_name").alias("l"), F.col("r_name").alias("r"), F.lit(1.0).alias("score")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("WITH t AS (SELECT DISTINCT p_partkey AS owner, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT token, round(ln(CAST((SELECT count(DISTINCT owner) FROM t) AS DOUBLE) / count(*)), 6) AS idf FROM t GROUP BY 1")
def a16_idf_file(spark, sf_dir):
    path = folder(spark)
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("owner"), F.explode(F.split("p_name", " ")).alias("token"))
    files.write_idf(vectors.idf(vectors.vectors(tokens)), path)
    return files.read_idf(spark, path).withColumn("idf", F.round("idf", 6))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"0\", nullif(o_orderstatus, 'P') AS \"1\" FROM orders")
def a19_numbered_relation(spark, sf_dir):
    """Columns by their number, a token read as null, one column hidden."""
    path = folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.csv(path)
    return files.numbered_relation(spark, path, null="P", hidden=(2,))
