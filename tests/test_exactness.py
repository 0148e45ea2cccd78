"""Cases in which a count, a bound or a parser could lose something."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stitchwork import catalog
from stitchwork.operators import context, dependencies, duplicates, evaluation, graph, matching, patterns, vectors
from stitchwork.sources import files


def test_one_violation_in_many_rows_is_seen(spark):
    df = spark.range(4_000_000).select((F.col("id") % 1000).alias("k"), F.when(F.col("id") == 7, -1).otherwise(F.col("id") % 10).alias("v"))
    found = dependencies.discover(df, ["k", "v"], 1)
    assert frozenset(["k"]) not in found
    assert dependencies.discover(df, ["k", "v"], 1, 0.99) == {frozenset(["k"]): frozenset(["v"])}


def test_column_names_with_signs(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3 * 2) for i in range(9)], "`a+b` int, `c.d` int, e int")
    found = dependencies.discover(df, df.columns)
    assert found[frozenset(["a+b"])] == {"c.d", "e"} and found[frozenset(["c.d"])] == {"e"} and found[frozenset(["e"])] == {"c.d"}


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,city\n"Smith, John",Paris\n\n"a ""b""","two\nlines"\n,x\n')
    rows = {(r.row_id, r.ord): r.v for r in files.csv_tables(spark, str(tmp_path)).collect()}
    assert rows == {(0, 0): "name", (0, 1): "city", (1, 0): "Smith, John", (1, 1): "Paris", (2, 0): 'a "b"', (2, 1): "two\nlines", (3, 0): None, (3, 1): "x"}


def test_deep_hierarchy_and_cycle(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(45)], "child string, parent string")
    assert graph.superclasses(chain).where("child = 'c0'").count() == 45
    with pytest.raises(ValueError, match="cycle"):
        graph.superclasses(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))


def test_components_of_chains_stars_and_loops(spark):
    chain, star = [(i, i + 1) for i in range(1, 80)], [(200, i) for i in range(201, 240)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (500, 400), (600, 600)], "l long, r long")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {i: 1 for i in range(1, 81)} | {i: 200 for i in range(200, 240)} | {400: 400, 500: 400, 600: 600}
    assert graph.components(links.limit(0)).collect() == []


def test_frequent_tokens_link(spark):
    kb = spark.createDataFrame([(i, "city", f"paris no{i}") for i in range(1001)] + [(5000, "city", "paris")], "id int, class string, label string")
    web = spark.createDataFrame([(1, "city", "Paris")], "id int, class string, label string")
    assert [(r.l, r.r, r.score) for r in matching.linked_entities(web, kb).collect()] == [(1, 5000, 1.0)]


def test_fuzzy_lookup_is_brute_force(spark):
    r = random.Random(2)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60)} | {"nousez", "mouses"})
    index = spark.createDataFrame([(n, n, "x") for n in names], "id string, label string, class string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    found = {(q.q, q.i): q.edits for q in matching.fuzzy_lookup(index, index, 2, 1000).collect()}
    assert found == {(a, b): edits(a, b) for a in names for b in names if edits(a, b) <= 2}


def test_url_clusters_take_the_greedy_loop(spark):
    """A value that also stands elsewhere takes those tables along, largest first."""
    urls = [f"http://s/a/{i}" for i in range(6)] + [f"http://s/b/{i}" for i in range(3)] + ["http://s/b/a", "http://s/c/b", "http://s/c/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = Counter(r.cluster for r in context.url_clusters(pages).collect())
    assert found == {"2:0=a": 6, "2:1=a": 1, "2:0=b": 3, "2:1=b": 1, "2:0=c": 1}
    assert set(Counter(r.cluster for r in context.url_clusters(pages, 0.9).collect())) == {"2:*"}


def test_block_filter_counts_pairs(spark):
    v = vectors.vectors(spark.createDataFrame([(o, t) for o in range(10) for t in ("all", f"t{o // 2}")], "owner int, token string"), "binary")
    assert vectors.dot_products(v, v).count() == 90
    assert vectors.dot_products(v, v, max_pairs=4).count() == 10
    assert vectors.dot_products(v, v, 0.9).count() == 10


def test_duplicates_by_any_key(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, None, "y"), (5, None, None)], "id int, k string, m string")
    assert {(r.l, r.r) for r in duplicates.within_table(df, "id", [["k"], ["m"]]).collect()} == {(1, 2), (2, 3)}
    assert {r.entity for r in duplicates.deduplicated(df, "id", [["k"], ["m"]], ["k", "m"], False).collect()} == {1, 4}
    assert {r.entity for r in duplicates.deduplicated(df, "id", [["k"], ["m"]], ["k", "m"]).collect()} == {4}


def test_filters_cluster_tables(spark):
    edges = spark.createDataFrame([("1a", "2a", 1, 2), ("2b", "3b", 2, 3), ("1c", "3c", 1, 3)], "l string, r string, l_table int, r_table int")
    fine = spark.createDataFrame([(1, 2), (2, 3)], "l_table int, r_table int")
    kept = {(r.l_table, r.r_table) for r in matching.within_table_clusters(edges, fine).collect()}
    assert kept == {(1, 2)}  # the pair of 1 and 3 was not kept, so that one cluster of all three is not possible


def test_relation_scores_map_tables_one_to_one(spark):
    cells = lambda rows: spark.createDataFrame(rows, "table string, row int, column string, v string")
    ref = cells([("a", i, "c", "x") for i in range(4)] + [("b", i, "c", "x") for i in range(4, 6)])
    ext = cells([("e", i, "c", "x") for i in range(6)])
    rows = {r.table: (r.extracted, r.correct, r.precision, r.recall) for r in evaluation.relation_scores(ref, ext).collect()}
    assert rows == {"a": ("e", 4.0, 0.666667, 1.0), "b": (None, 0.0, 0.0, 0.0)}


def test_stop_words_are_those_of_templates():
    assert len(patterns.STOP_WORDS) == 33 and {"but", "such", "then", "no", "their"} <= set(patterns.STOP_WORDS)


def test_classes_by_linking_is_its_sql_at_halves(spark, tmp_path):
    r, parts = random.Random(3), []
    for b in range(120):
        n = r.choice([32, 64, 96])
        parts += [(f"Brand#{b}", "A" if i < 13 else f"T{i}", r.randint(1, 50)) for i in range(n)]
    parts = [(i, *p) for i, p in enumerate(parts)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    expected = {(b, c): s for b, c, s in con.execute(catalog.ORACLE_SQL["i32_classes_by_linking"]).fetchall()}
    found = {(x.col_id, x["class"]): x.score for x in catalog.QUERIES["i32_classes_by_linking"](spark, str(tmp_path)).collect()}
    assert len(expected) > 100 and found == expected


def test_classes_by_linking_in_any_order_of_rows(spark):
    r, sizes = random.Random(4), [9, 38, 50, 20, 47, 43, 42, 34, 32, 19, 28]
    links = [(str(k), i, x / 100) for k in range(50) for i, x in enumerate(r.sample(sizes, len(sizes)))]
    links += [("large", 1, 5e9), ("large", 2, 0.25), ("none", 1, float("nan")), ("none", 2, 0.5), ("null", 1, None), ("null", 2, 6.4)]
    links = spark.createDataFrame(links, "col_id string, entity int, score double").withColumn("class", F.lit("x")).coalesce(1)
    found = {x.col_id: x.score for x in matching.classes_by_linking(links, links.select("col_id").distinct().withColumn("n", F.lit(64)), 2).collect()}
    assert {found[str(k)] for k in range(50)} == {0.056563}
    assert found["large"] == 78125000.003906 and math.isnan(found["none"]) and found["null"] == 0.1
