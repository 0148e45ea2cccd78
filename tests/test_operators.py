"""Operators on small fixtures with known results."""

import itertools
import random

from pyspark.sql import functions as F

from stitchwork.functions import similarity, text
from stitchwork.operators import context, dependencies, evaluation, graph, matching, ranking, relational, stitching
from stitchwork.plans import dependencies as algebra


def values(spark, function, *cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_cell_functions(spark):
    assert values(spark, text.bracket_text, "A (b) (c)", "A", None, "()") == ["c", None, None, ""]
    assert values(spark, text.without_brackets, "A (b) (c)", "(x)", None) == ["A", None, None]
    assert values(spark, text.leading_number, "12. Name", ". Name", "Name", None) == [12.0, None, None, None]
    assert values(spark, text.without_leading_number, "12. Name", "Name") == ["Name", "Name"]
    assert values(spark, text.normalised_cell, "1. Ab-C! (x) [y]", "???") == ["abc", None]
    assert values(spark, text.without_filename, "see my,file-1.html", "index.php", "a.txt") == ["see", None, "a.txt"]
    assert values(spark, text.without_numbers, "a 12.5% b", "1e5", "0x1F", None) == ["a  b", None, None, None]
    assert values(spark, lambda c: text.at_least(c, 3), "ab", "abc") == [None, "abc"]
    assert values(spark, text.tokens, "The U.S.-Mexico 2x", "", None) == [["the", "u", "s", "mexico", "2x"], [], None]
    assert values(spark, lambda c: text.tokens(c, ("the",)), "The end") == [["end"]]
    assert values(spark, text.without_time, "May 5, 2011 concert", "founded 1999-2004", "10:30 am", "lasted 3 days") == ["concert", "founded", None, "lasted"]


def test_similarities(spark):
    row = spark.range(1).select(
        similarity.token_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), similarity.token_containment(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("c"),
        similarity.deviation(F.lit(5.0), F.lit(10.0)).alias("d"), similarity.deviation(F.lit(-5.0), F.lit(10.0)).alias("n"), similarity.edit_similarity(F.lit("abcd"), F.lit("abxd")).alias("e"),
        similarity.date_similarity(F.lit("2001-02-03").cast("timestamp"), F.lit("2006-02-03").cast("timestamp")).alias("t"),
        similarity.combined([(F.lit(1.0), 1), (F.lit(0.0), 3)], 0.2).alias("w"), similarity.combined([(F.lit(1.0), 1), (F.lit(0.0), 3)], 0.3).alias("x"),
        similarity.over_lists(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0)), similarity.deviation).alias("l"), similarity.over_lists(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0)), similarity.deviation, True).alias("s"),
        matching.typed_vote(F.lit("5"), F.lit("10"), "numeric").alias("v"), matching.context_fallback(F.lit(None).cast("string"), F.lit("x"), F.array(F.lit("x"))).alias("f"),
    ).first()
    assert (round(row.j, 3), row.c, row.d, row.n, row.e, round(row.t, 3), row.w, row.x, row.l, row.s, row.v, row.f) == (0.333, 1.0, 0.5, 0.0, 0.75, 0.722, 0.25, None, 1.0, 0.5, 0.5, 1.0)


def test_url_context(spark):
    pages = spark.createDataFrame([(1, "http://s/a-b/2001?x=1&x=2&y=%20z"), (2, "http://s/a-b/2002"), (3, "http://s/c/2002"), (4, "http://s")], "page_id int, url string")
    assert sorted((r.page_id, r.pos, r.value) for r in context.uri_path_parts(pages).collect())[:2] == [(1, 0, "a b"), (1, 1, "2001")]
    assert sorted((r.header, r.value) for r in context.uri_query_parts(pages).collect()) == [("uri x", "1"), ("uri x[2]", "2"), ("uri y", " z")]
    assert {r.page_id: r.cluster for r in context.url_clusters(pages).collect()} == {1: "2:0=a b", 2: "2:0=a b", 3: "2:0=c", 4: "0:*"}
    headers = spark.createDataFrame([(h,) for h in ("Page Title", "uri 0", "uri year", "Disambiguation of x", "name", "uri")], "h string")
    assert [r[0] for r in headers.where(context.is_context(F.col("h"))).collect()] == ["Page Title", "uri 0", "uri year", "Disambiguation of x"]


def test_dedup_policies(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "x"), (None, None, "y")], "k string, n int, s string")
    assert {(r.k, r.n, r.s) for r in relational.replace_nulls(df, ["k"], ["n", "s"]).collect()} == {("a", 1, "x"), (None, None, "y")}
    assert {(r.k, tuple(r.n)) for r in relational.create_set(df, ["k"], ["n"]).collect()} == {("a", (1,)), ("b", (1, 2)), (None, ())}
    assert {r.k for r in relational.conflicts(df, ["k"], ["n", "s"]).collect()} == {"b"}
    assert relational.keep_both(df, ["k"], ["s"]).count() == 4
    assert {(r.k, r.n) for r in relational.keep_first(df, ["k"], ["n"]).collect()} == {("a", 1), ("b", 1), (None, None)}
    assert relational.enforce_keys(df, [["k", "s"], ["n", "s"]]).count() == 3
    assert relational.without_sparse_columns(df.withColumn("z", F.lit(None).cast("int")), 0.5).columns == ["k", "n", "s"]
    assert relational.has_content(df, ["n"]).count() == 4
    assert relational.fill_cover({"t": {"a", "b"}, "u": {"c"}, "v": {"a"}}, {"a", "b", "c", "d"}) == ["t", "u"]


def test_assignments_are_brute_force(spark):
    r = random.Random(1)
    for _ in range(150):
        n, m = r.randint(1, 5), r.randint(1, 5)
        w = [[r.choice([0.0, r.random()]) for _ in range(m)] for _ in range(n)]
        best = max(sum(w[i][j] for i, j in zip(rows, cols)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        found = ranking.assignment(w)
        assert abs(sum(w[i][j] for i, j in enumerate(found) if j >= 0) - best) < 1e-9
        assert len({j for j in found if j >= 0}) == sum(j >= 0 for j in found)
    edges = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.8), (2, "a", "x", 0.1)], "g int, l string, r string, score double")
    assert {(e.g, e.l, e.r) for e in ranking.greedy_one_to_one(edges, ["g"]).collect()} == {(1, "a", "x"), (2, "a", "x")}
    assert {(e.g, e.l, e.r) for e in ranking.maximum_matching(edges, ["g"]).collect()} == {(1, "a", "y"), (1, "b", "x"), (2, "a", "x")}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100)], "l int, r int")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_small_graph_algorithms():
    assert graph.signed_clusters([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", -1.0), ("c", "d", 0.7)]) == [{"a", "b"}, {"c", "d"}]
    assert graph.complete_link([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.1)], 0.5) == [{"c"}, {"a", "b"}]
    assert graph.edge_betweenness({1: {2}, 2: {1, 3}, 3: {2}}) == {(1, 2): 2.0, (2, 3): 2.0}
    # a and d are two columns of table 1: an edge between other headers goes, and the ones alike stay
    table, header = {"a": 1, "b": 2, "c": 3, "d": 1}, {"a": "name", "b": "name", "c": "title", "d": "title"}
    assert graph.refine([("a", "b"), ("b", "c"), ("c", "d")], table, header, set()) == [("a", "b"), ("c", "d")]


def test_hierarchy_scores(spark):
    h = spark.createDataFrame([("city", "place"), ("place", "thing")], "child string, parent string")
    s = spark.createDataFrame([("c", "city", 1.0), ("c", "place", 0.5), ("c", "thing", 0.2)], "col string, class string, score double")
    assert {(r["class"], r.score) for r in graph.propagated_scores(s, h).collect()} == {("city", 1.0), ("place", 1.5), ("thing", 1.7)}
    assert {(r["class"], r.score) for r in graph.corrected_scores(s, h).collect()} == {("city", 1.25), ("place", 0.6), ("thing", 0.2)}


def test_discovered_dependencies(spark):
    r = random.Random(4)
    rows = []
    for i in range(200):
        a, c = r.randint(0, 9), r.randint(0, 4)
        rows.append((a, a % 4, c, 10 * a + c, "k", -1 if i < 5 else a))
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string, f int")
    found = dependencies.discover(df, list("abcdef"), 2)
    assert found[frozenset()] == {"e"} and "b" in found[frozenset("a")] and "f" not in found[frozenset("a")]
    assert "d" in found[frozenset("ac")]
    approximate = dependencies.discover(df, list("abcdef"), 1, 0.95)
    assert "f" in approximate[frozenset("a")]
    relations = algebra.boyce_codd_normal_form("abcdef", {frozenset("a"): frozenset("b"), frozenset("ac"): frozenset("d")})
    parts = dependencies.decomposed(df, relations)
    assert parts["a"].count() == 10


def test_matching_fixture(spark):
    columns = spark.createDataFrame([(1, "1a", "name", False), (1, "1b", "year", False), (2, "2a", "name", False), (2, "2b", "year", False), (3, "3a", "name", False), (3, "3b", "page title", True)], "table_id int, col_id string, header string, is_context boolean")
    labels = matching.label_matches(columns)
    assert {(r.l, r.r) for r in labels.collect()} == {("1a", "2a"), ("1b", "2b"), ("1a", "3a"), ("2a", "3a")}
    assert {(r.l_table, r.r_table) for r in matching.fully_mapped(labels, columns, "both").collect()} == {(1, 2)}
    assert {(r.l_table, r.r_table) for r in matching.fully_mapped(labels, columns, "one").collect()} == {(1, 2), (1, 3), (2, 3)}
    keys = spark.createDataFrame([(1, ["1a", "1b"]), (3, ["3a"])], "table_id int, cols array<string>")
    assert {(r.l_table, r.r_table, r.left_key, r.right_key) for r in matching.key_mapped(labels, keys).collect()} == {(1, 2, True, False), (1, 3, False, True), (2, 3, False, True)}
    disjoint = graph.disjoint_headers(columns.select("table_id", "header"))
    wrong = spark.createDataFrame([("1a", "2b")], "l string, r string")
    assert ("1a", "2b") not in {tuple(r) for r in matching.pairwise_refined(wrong, labels, columns, disjoint).collect()}
    provenance = spark.createDataFrame([("X", "1a"), ("Y", "2a")], "target string, source string")
    assert {tuple(r) for r in matching.projected(labels, provenance).collect()} == {("X", "Y")}
    generated = spark.createDataFrame([("1a", "disamb", "1d"), ("2a", "disamb", "2d")], "source string, kind string, generated string")
    assert {tuple(r) for r in matching.generated_matches(labels, generated).collect()} == {("1d", "2d")}
    assert {r.col_id: r.mapped for r in matching.translated(columns, labels).collect()}["1a"] == ["2a", "3a"]
    dets = spark.createDataFrame([("d1", 1, ["1a", "1b"]), ("d2", 2, ["2b", "2a"]), ("d3", 3, ["3a"])], "det_id string, table_id int, cols array<string>")
    assert {tuple(r) for r in matching.determinant_matches(dets, labels).collect()} == {("d1", "d2")}
    web = spark.createDataFrame([("w1", "city", "New York"), ("w2", "city", "Paris Texas")], "id string, class string, label string")
    kb = spark.createDataFrame([("k1", "city", "york new"), ("k2", "city", "Paris"), ("k3", "film", "New York")], "id string, class string, label string")
    assert {(r.l, r.r) for r in matching.linked_entities(web, kb).collect()} == {("w1", "k1")}
    assert {(r.q, r.i) for r in matching.fuzzy_lookup(web, kb, 2, 1).collect()} == {("w1", "k1"), ("w2", "k2")}


def test_linked_entities_are_brute_force(spark):
    r = random.Random(3)
    label = lambda: " ".join(r.choice(["saint", "saint", "saint", "john", "mary", "bay", "cape", "x1", "x2"]) for _ in range(r.randint(1, 5)))
    web, kb = ([(f"{side}{i:02}", r.choice("ab"), label()) for i in range(60)] for side in "wk")
    kb += [(f"s{i}", "c", f"saint n{i}") for i in range(1500)] + [("s", "c", "saint john")]
    web += [("w", "c", "Saint John")]
    expect = set()
    for c in "abc":
        scores = {}
        for i, _, x in (row for row in web if row[1] == c):
            for j, _, y in (row for row in kb if row[1] == c):
                s, t = set(x.lower().split()), set(y.split())
                if (score := round(len(s & t) / len(s | t), 6)) >= 0.6:
                    scores[i, j] = score
        first_l = {i: min((-v, j) for (l, j), v in scores.items() if l == i) for i, _ in scores}
        first_r = {j: min((-v, i) for (i, k), v in scores.items() if k == j) for _, j in scores}
        expect |= {(i, j, c, v) for (i, j), v in scores.items() if first_l[i] == (-v, j) and first_r[j] == (-v, i)}
    tables = [spark.createDataFrame(rows, "id string, class string, label string") for rows in (web, kb)]
    found = [tuple(row) for row in matching.linked_entities(*tables).collect()]
    assert ("w", "s", "c", 1.0) in found and sorted(found) == sorted(expect)


def test_fuzzy_lookup_is_brute_force(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(11)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["0s", "24s", "0", "24", "bcdefghijk", "xcdefghijz"]
    queries, index = ([(i, " ".join(r.choice(words) for _ in range(r.randint(1, 3))), r.choice([None, "a", "b"])) for i in range(40)] for _ in range(2))
    tables = [spark.createDataFrame(rows, "id int, label string, class string") for rows in (queries, index)]
    for distance in (0, 1, 2, 3):
        expect = {}
        for q, x, c in queries:
            for i, y, d in index:
                near = {s: min(edits(s, t) for t in y.split()) for s in x.split()}
                common = sum(n <= distance for n in near.values())
                if common and (c is None or c == d):
                    expect[q, i] = (common, min(near.values()))
        found = {(row.q, row.i): (row.common, row.edits) for row in matching.fuzzy_lookup(*tables, distance, 1000).collect()}
        assert found == expect, distance


def test_stitching_fixture(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "p")], "id int, name string, place string")
    merged = stitching.merged_entities(a.union(spark.createDataFrame([(3, "z", "q")], a.schema)), spark.createDataFrame([(1, 3)], "l int, r int"), "id", ["name", "place"])
    assert {(r.entity, r.name, r.place, r.n_rows) for r in merged.collect()} == {(1, "x", "q", 2), (2, "y", "p", 1)}
    assert stitching.subject_column(a, ["id", "place", "name"]) == "name"
    headers = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (2, 0, "a"), (2, 1, "b"), (2, 2, "b")], "table_id int, ord int, header string")
    assert [r[0] for r in stitching.stacked_tables(headers).collect()] == [1]
    cells = spark.createDataFrame([(1, 0, "c0", None), (1, 1, "c0", "name"), (1, 1, "c1", "year"), (1, 2, "c0", "x")], "table_id int, row_id int, col_id string, v string")
    assert {(r.col_id, r.header) for r in stitching.repaired_header(cells).collect()} == {("c0", "name"), ("c1", "year")}
    typed = spark.createDataFrame([("n", "1"), ("n", "2.5"), ("n", "x"), ("d", "2001-01-01"), ("b", "true"), ("s", "abc")], "col_id string, v string")
    assert {(r.col_id, r.type) for r in stitching.inferred_types(typed).collect()} == {("n", "numeric"), ("d", "date"), ("b", "boolean"), ("s", "string")}
    heads = spark.createDataFrame([("t", "x", 1), ("t", "y", 3), ("t", None, 9)], "target string, header string, n int")
    assert [tuple(r) for r in stitching.majority_headers(heads).collect()] == [("t", "y")]


def test_scores(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id int, cluster string")
    found = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "id int, cluster string")
    r = evaluation.pairwise(gold, found).first()
    assert (r.correct, r.created, r.total, r.precision, r.recall) == (1.0, 2.0, 3.0, 0.5, 0.333333)
    assert evaluation.muc(gold, found).first() == (0.5, 0.5)
    sizes = {("g", "a"): 3, ("g", "b"): 1, ("f", "x"): 2, ("f", "y"): 2}
    assert evaluation.cluster_scores([("a", "x", 2), ("a", "y", 1), ("b", "y", 1)], sizes)["precision"] == 0.75
    assert evaluation.best_mapping([("a", "x", 2), ("a", "y", 1), ("b", "y", 1)]) == [("a", "x", 2), ("b", "y", 1)]
    fds = algebra.make([("a", "b"), ("b", "c")])
    assert evaluation.dependency_scores(fds, algebra.make([("a", "c")]), algebra.closure) == {"precision": 0.0, "recall": 1.0, "f1": 0.0}
