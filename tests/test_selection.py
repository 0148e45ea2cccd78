from functools import partial

from pyspark.sql import functions as F

from stitchwork.operators import selection, vectors
from stitchwork.plans import dependencies as d


def test_selection(spark, tmp_path):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    assert selection.without_keys(rows([(1, 2, 3)], "PK int, a int, fk int")).columns == ["a"]
    tuples = rows([("t", "a", "1"), ("t", "b", "2")], "`table` string, attribute string, value string")
    chosen = selection.selected_tuples(tuples, rows([("t", "b", "out")], "`table` string, attribute string, output string"))
    selection.write_selected(chosen, str(tmp_path / "o"))
    assert [r.value for r in spark.read.parquet(str(tmp_path / "o/output=out")).collect()] == ["2"]
    edges = rows([("a", "x", 0.5), ("b", "y", 0.4)], "l string, r string, score double")
    profile = rows([("a", 1.0), ("b", 0.9)], "column string, density double")
    assert [r.l for r in selection.dense_edges(edges, profile).collect()] == ["a"]
    scores = selection.reference_scores(rows([("t",), ("u",)], "`table` string"), rows([("t", "m")], "`table` string, match string"), rows([("m", 0.7)], "match string, score double"))
    assert {(r["table"], r.score) for r in scores.collect()} == {("t", 0.7), ("u", 0.0)}
    assert {(r.l, round(r.score, 3)) for r in selection.weighted_edges(edges, rows([("x", 2.0), ("y", 0.5)], "id string, weight double")).collect()} == {("a", 1.0), ("b", 0.2)}
    records = rows([(1, "r", "c0", "v"), (1, "r", "c1", "w")], "table_id int, row_id string, col_id string, v string")
    assert [r.label for r in selection.labelled_records(records, rows([(1, "c1")], "table_id int, label string")).collect()] == ["w"]
    cells = rows([("a", "x", 1, 0.5, 3), ("b", "y", 1, 1.0, 1)], "l string, r string, `table` int, score double, cells int")
    assert {(r.l, r.score) for r in selection.normalised_scores(cells).collect()} == {("a", 0.5), ("b", 0.5)}
    nested = rows([("a", "b", "a1", "b1"), ("a", "b", "a1", "c1")], "l string, r string, cause_l string, cause_r string")
    sources = rows([("a", 1), ("a1", 1), ("b", 2), ("b1", 2), ("c1", 3)], "id string, source int")
    assert [r.cause_r for r in selection.causes(nested, sources).collect()] == ["b1"]
    mapped = rows([(1, "City", "p"), (1, "City", "q"), (2, "City", "p")], "`table` int, class string, property string")
    assert [r["table"] for r in selection.complete_tables(mapped, rows([("City", "p"), ("City", "q")], "class string, property string")).collect()] == [1]
    columns = rows([("a", "k"), ("b", "k"), ("c", "z")], "col_id string, class string")
    tokens = rows([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "owner string, token string")
    assert [(r.l, r.r, r.score) for r in selection.relation_edges(columns, tokens).collect()] == [("a", "b", 0.5)]
    own = rows([(1, "a"), (2, "x")], "table_id int, col_id string")
    e, c, k = selection.of_tables(rows([(1,)], "table_id int"), edges, own, rows([(1, ["a"]), (2, ["x"])], "table_id int, cols array<string>"))
    assert (e.count(), c.count(), k.count()) == (0, 1, 1)
    assert selection.by_subject(own, rows([(1, "a")], "table_id int, col_id string")).count() == 1
    named = selection.renamed_by_sources(rows([("c", "s1"), ("c", "s2"), ("c", "s3")], "col_id string, source string"), rows([("n", "s1"), ("m", "s2"), ("m", "s3")], "name string, source string"))
    assert [tuple(r) for r in named.collect()] == [("c", "m")]


def test_vectors_of_single_strings(spark):
    corpus = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a")], "owner string, token string")
    idf = vectors.idf(vectors.vectors(corpus))
    one = spark.createDataFrame([("q", "b"), ("q", "new")], "owner string, token string")
    v = {r.token: round(r.weight, 4) for r in vectors.tf_idf(vectors.vectors(one), idf).collect()}
    assert v == {"b": 0.3466, "new": 0.0}
    assert idf.where("token = 'a'").select(F.round("idf", 4)).first()[0] == 0.0


def test_algebra_under_other_closures():
    fds = d.make([("a", "b"), ("b", "c")])
    nulls = partial(d.null_free_closure, null_free=frozenset())
    assert d.candidate_keys("abc", fds) == [frozenset("a")]
    assert frozenset("ab") in d.candidate_keys("abc", fds, close=nulls)
    assert d.equivalent(fds, d.make([("a", "bc"), ("b", "c")])) and not d.equivalent(fds, d.make([("a", "bc"), ("b", "c")]), nulls)
    assert d.all_closures(fds, nulls)[frozenset("a")] == frozenset("ab")
    assert d.minimised(d.make([("ab", "c"), ("a", "b")]), nulls) == d.make([("ab", "c"), ("a", "b")])
