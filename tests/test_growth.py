"""Work must not grow faster than the input, nor fall to one task, where keys are few and rows many."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stitchwork import catalog
from stitchwork.operators import dependencies, evaluation, graph, knowledge, matching, relational, selection


def rows_made(spark, run, kinds):
    """What run() returns, and the most rows that one plan node of these kinds made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    most, found = 0, store.executionsList()
    for k in range(seen, found.size()):
        i = found.apply(k).executionId()
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            metrics = n.metrics()
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if re.search(kinds, n.name()) and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def shares(df):
    """The share of the rows that the fullest partition has."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Many parts with few names, all of one type and size."""
    d = str(tmp_path_factory.mktemp("parts"))
    brand = F.concat(F.lit("Brand#"), (F.col("id") % 3).cast("string"))
    names = F.when(F.col("id") % 3 == 0, "red nut").when(F.col("id") % 3 == 1, "old nut").otherwise("new nut")
    spark.range(1500).select(F.col("id").alias("p_partkey"), names.alias("p_name"), brand.alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit(7).alias("p_size")).write.parquet(f"{d}/part.parquet")
    return d


def test_header_synonyms_of_many_equal_names(spark, parts):
    found, most = rows_made(spark, lambda: catalog.QUERIES["h09_header_synonyms"](spark, parts).collect(), "Join|Product")
    assert sorted(tuple(r) for r in found) == [("-", "-"), ("new nut", "new nut"), ("old nut", "new nut"), ("red nut", "new nut")]
    assert 0 < most < 15_000


def test_pairs_of_few_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(relational, "CELL_ROWS", 16)
    monkeypatch.setattr(relational, "GRID_PAIRS", 1000)
    key = F.when(F.col("id") < 400, 1).when(F.col("id") < 410, 2).when(F.col("id") >= 412, F.col("id") % 5 + 3)
    a = spark.range(500).coalesce(1).select(F.col("id").alias("l"), key.cast("int").alias("k"))
    b = spark.range(450).coalesce(1).select(F.col("id").alias("r"), key.cast("int").alias("k"))
    plain = sorted(tuple(r) for r in a.join(b, "k").select("l", "r").collect())
    found = relational.all_pairs(a, b, ["k"])
    assert found.columns == ["k", "l", "r"] and sorted(tuple(r) for r in found.select("l", "r").collect()) == plain
    assert shares(found) < 0.5
    assert relational.all_pairs(a, b.limit(0), ["k"]).collect() == []
    assert {tuple(r) for r in graph.paired(a, "l", ["k"]).where("l = 405").collect()} == {(405, i) for i in range(400, 410)}


def test_schema_votes_count_pairs(spark, tmp_path):
    money = lambda x: ((F.col("id") * 37) % 13 * 1000.0).alias(x)
    spark.range(600).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).cast("int").alias("s_nationkey"), money("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(900).select(F.col("id").alias("c_custkey"), (F.col("id") % 2).cast("int").alias("c_nationkey"), money("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    found, most = rows_made(spark, lambda: catalog.QUERIES["i08_schema_votes"](spark, str(tmp_path)).collect(), "Join|Product")
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(tuple(r) for r in found) == sorted(con.execute(catalog.ORACLE_SQL["i08_schema_votes"]).fetchall())
    assert 0 < most < 1500


def test_schema_votes_of_a_key_are_those_of_its_pairs(spark):
    rows = lambda n, m: spark.createDataFrame([(i, i % 3 or None, "ab"[i % 2], i % m or None) for i in range(n)], "id int, k int, k2 string, `a~b` int")
    left, right, on = rows(40, 5), rows(31, 4), [("k", "k"), ("k2", "k2")]
    columns = ["k", "a~b"]
    pairs = matching.duplicates_by_key(left, right, "id", "id", on)
    as_made = sorted(tuple(r) for r in matching.schema_votes(pairs, left, right, "id", "id", columns, columns).collect())
    assert as_made and sorted(tuple(r) for r in matching.schema_votes_by_key(left, right, on, columns, columns).collect()) == as_made
    assert matching.schema_votes_by_key(left, right.limit(0), on, columns, columns).collect() == []


def test_string_similarities_of_many_equal_names(spark, parts):
    found, most = rows_made(spark, lambda: catalog.QUERIES["j07_string_similarities"](spark, parts).collect(), "Join|Product")
    assert len(found) == 9 and {r.score for r in found if r.l == r.r} == {1.0}
    assert 0 < most < 15_000


def test_expanded_edges_are_not_shuffled(spark):
    sources = spark.range(600).select((F.col("id") % 2).alias("target"), F.col("id").alias("source"))
    edges = spark.createDataFrame([(0, 1), (1, 1), (0, 1)], "l long, r long")
    found, most = rows_made(spark, lambda: evaluation.expanded(edges, sources).collect(), "Aggregate")
    assert len(found) == len({tuple(r) for r in found}) == 2 * 300 * 300
    assert 0 < most < 15_000


def test_expanded_edges_of_sources_with_many_targets(spark):
    owned = [(t, s) for s in range(30) for t in range(6) if (s * 7 + t * 5) % 4 == 0] + [(1, 4), (1, 4), (None, 3), (2, None)]
    linked = [(0, 1), (1, 1), (3, 2), (0, 1), (5, 9), (None, 2)]
    provenance, edges = spark.createDataFrame(owned, "target int, source int"), spark.createDataFrame(linked, "l int, r int")
    expected = {(a, b) for l, r in linked for t, a in owned for u, b in owned if None not in (l, r, t, u) and t == l and u == r}
    found = [tuple(x) for x in evaluation.expanded(edges, provenance).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_duplicates_of_one_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(relational, "CELL_ROWS", 256, raising=False)
    left = spark.range(3000).coalesce(1).select(F.col("id").alias("a"), (F.col("id") % 1).alias("k"))
    right = spark.range(3000).coalesce(1).select(F.col("id").alias("b"), (F.col("id") % 1).alias("m"))
    found = matching.duplicates_by_key(left, right, "a", "b", [("k", "m")])
    assert found.distinct().count() == found.count() == 9_000_000
    assert shares(found) < 0.6


@pytest.fixture(params=[100_000, 0])
def metadata_rows(request, monkeypatch, spark):
    """Metadata broadcast, and more of it than that; rows that are too many to be broadcast."""
    monkeypatch.setattr(relational, "METADATA_ROWS", request.param, raising=False)
    monkeypatch.setattr(relational, "GRID_PAIRS", 100, raising=False)
    monkeypatch.setattr(relational, "CELL_ROWS", 16, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_of_one_table_stay_dealt_out(spark, metadata_rows):
    records = spark.range(1000).repartition(8).select(F.lit(0).alias("table_id") + F.col("id") % 1, F.col("id").cast("string").alias("row_id"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("col_id"), F.lit("x").alias("v")).toDF("table_id", "row_id", "col_id", "v")
    found = selection.labelled_records(records, spark.createDataFrame([(0, "c1"), (1, "c0")], "table_id int, label string"))
    assert found.columns == ["table_id", "row_id", "label"] and found.distinct().count() == 500
    assert shares(found) < 0.6


def test_tuples_of_one_attribute_stay_dealt_out(spark, metadata_rows):
    tuples = spark.range(1000).repartition(8).select(F.concat(F.lit("t"), (F.col("id") % 1).cast("string")), F.concat(F.lit("a"), (F.col("id") % 2).cast("string")), F.col("id")).toDF("table", "attribute", "value")
    wanted = spark.createDataFrame([("t0", "a0", "one"), ("t0", "a0", "two"), ("t1", "a1", "none")], "`table` string, attribute string, output string")
    found = selection.selected_tuples(tuples, wanted)
    assert found.columns == ["table", "attribute", "value", "output"] and found.distinct().count() == found.count() == 1000
    assert shares(found) < 0.6


def test_linked_values_of_one_pair_of_columns_are_not_sent_to_one_task(spark, metadata_rows):
    values = lambda name, of: spark.range(300).select(F.col("id"), F.lit(of).alias(name), (F.col("id") % 7).cast("string").alias("v"))
    web, kb = values("column", "pop").union(values("column", "other")), values("property", "size").union(values("property", "name"))
    kind = spark.createDataFrame([("pop", "size", "numeric"), ("pop", "name", "string"), ("none", "size", "date")], "column string, property string, type string")
    found = knowledge.duplicate_based(spark.range(300).select(F.col("id").alias("l"), F.col("id").alias("r")), web, kb, kind)
    assert sorted(tuple(r) for r in found.collect()) == [("pop", "name", 1.0), ("pop", "size", 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert len(re.findall(r"hashpartitioning\(column#\d+, property", plan)) == 1  # for the result; a join would need two more


def test_exact_dependencies_group_each_row_once_for_a_determinant(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 500).alias("a"), (F.col("id") % 50).alias("b"), (F.col("id") % 3).alias("c"), F.concat(F.lit("n"), (F.col("id") % 50).cast("string")).alias("d"))
    found, most = rows_made(spark, lambda: dependencies.discover(df, df.columns, 1), "Generate|Expand|Inline")
    assert found == {frozenset([x]): frozenset(y) for x, y in (("id", "abcd"), ("a", "bd"), ("b", "d"), ("d", "b"))}
    assert 0 < most <= 5 * 20_000


def by_brute_force(rows, columns, max_size):
    """Minimal dependencies of rows, null being a value."""
    groups = lambda cs: len({tuple(r[columns.index(c)] for c in cs) for r in rows})
    found = {}
    constant = frozenset(c for c in columns if groups([c]) <= 1)
    if constant:
        found[frozenset()] = constant
    for size in range(1, max_size + 1):
        new = {}
        for det in itertools.combinations([c for c in columns if c not in constant], size):
            deps = frozenset(a for a in columns if a not in constant and a not in det and not any(d <= set(det) and a in dep for d, dep in found.items()) and groups(det) == groups((*det, a)))
            if deps:
                new[frozenset(det)] = deps
        found |= new
    return found


@pytest.mark.parametrize("bits", [7, 0])
def test_exact_dependencies_are_those_of_brute_force(spark, monkeypatch, bits):
    """Whatever the hashes tell: with no bits, all is settled by counting."""
    monkeypatch.setattr(dependencies, "HASH_BITS", bits, raising=False)
    monkeypatch.setattr(dependencies, "JOB_CANDIDATES", 16)
    monkeypatch.setattr(dependencies, "JOB_COLUMNS", 7, raising=False)
    for seed in range(2):
        r, rows = random.Random(seed), []
        for _ in range(60):
            a, b = r.choice([None, 1, 2, 3, 4]), r.choice("xyz")
            rows.append((a, b, None if a is None else a % 2, f"{a}{b}", r.choice([None, "k"]), 1.5 if b == "x" else float(a or 0), None, f"{a}{b}" if r.random() < 0.98 else "other", len(rows) if seed else r.randint(0, 50), "c"))
        columns = ["a", "b", "c.d", "e+f", "g", "h", "i", "j", "k", "l"]
        df = spark.createDataFrame(rows, "a int, b string, `c.d` int, `e+f` string, g string, h double, i string, j string, k int, l string")
        assert dependencies.discover(df, columns, 2) == by_brute_force(rows, columns, 2)
    empty = df.limit(0)
    assert dependencies.discover(empty, columns) == {frozenset(): frozenset(columns)}
    assert dependencies.discover(df.withColumn("z", F.lit(None)), ["b", "z"]) == {frozenset(): frozenset(["z"])}
