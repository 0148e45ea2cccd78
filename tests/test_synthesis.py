import json

import pytest
from pyspark.sql import functions as F

from stitchwork.operators import evaluation, knowledge, matching, patterns, stitching
from stitchwork.plans import dependencies as d
from stitchwork.plans import synthesis
from stitchwork.streaming import arrivals


@pytest.fixture(scope="module")
def site(spark):
    out = []
    for y in (2001, 2002):
        for section in ("north", "south"):
            rows = [(f"{section} state {i % 3}", f"job {i % 4}", 100 * y + 10 * (i % 3) + i % 4 + (1000 if section == "north" else 0)) for i in range(12)]
            out.append(synthesis.WebTable(f"http://s/{section}/{y}", spark.createDataFrame(rows, "state string, profession string, employment int"), "Employment", None))
    out.append(synthesis.WebTable("http://s/about", spark.createDataFrame([("x", "y")], "name string, value string")))
    return out


def test_context_makes_the_key(site):
    unions = synthesis.union_with_context(site)
    df = unions["state+profession+employment"]
    assert set(df.columns) == {"state", "profession", "employment", "uri 0", "uri 1"} and df.count() == 48
    fds, relations = synthesis.normalised(df, 3)
    assert "employment" in d.closure({"state", "profession", "uri_1"}, fds)
    assert "employment" not in d.closure({"state", "profession"}, fds) and "uri_0" in d.closure({"state"}, fds)
    assert relations["state"].count() == 6
    assert len(synthesis.synthesised(site, min_rows=2)) == 1


def test_query_parameters():
    t = synthesis.WebTable("http://s/a-b?x=1&x=2&y%5B=%20q", None, "T")
    assert t.context() == {"page title": "T", "uri 0": "a b", "uri x": "1", "uri x[2]": "2", "uri y5B": " q"}


def test_templates(spark):
    assert patterns.template(["born in Rome and lives", "born in Paris and lives"]) == r"born\ in\ (.*)\ and\ lives"
    rows = [("c", f"the flight number {i} leaves today") for i in range(40)] + [("c", "other"), ("d", None)]
    cells = spark.createDataFrame(rows, "col_id string, v string")
    found = patterns.mined(cells).collect()
    assert [(r.support, r.n_values) for r in found] == [(40, 40)]
    out = spark.createDataFrame([("a 1 b 2",), ("zzz",)], "v string").select(patterns.applied(F.col("v"), [r"a (.*) b (.*)"])).collect()
    assert [r[0] for r in out] == [["1", "2"], None]


def test_templates_cover_all_values(spark):
    values = [f"the flight number {i} leaves today" for i in range(2000)] + ["zz flight number 7 stays today"]
    cells = spark.createDataFrame([("c", v) for v in values], "col_id string, v string")
    assert [tuple(r) for r in patterns.mined(cells).collect()] == [("c", patterns.template(sorted(values)), 2001, 2001)]


def test_determinants_of_four_columns(spark):
    rows = [(a, b, c, d, str((a + b + c + d) % 2)) for a in range(2) for b in range(2) for c in range(2) for d in range(2)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string")
    cover, _ = synthesis.normalised(df)
    assert cover[frozenset("abcd")] == {"e"}


def test_knowledge(spark):
    web = spark.createDataFrame([("w.name", "string", "New York"), ("w.name", "string", "Paris"), ("w.pop", "numeric", "8000000")], "owner string, type string, v string")
    kb = spark.createDataFrame([("k.label", "string", "york new"), ("k.label", "string", "Rome"), ("k.size", "numeric", "8000000"), ("k.note", "string", "8000000")], "owner string, type string, v string")
    assert {(r.l, r.r) for r in knowledge.schema_matches(web, kb).collect()} == {("w.name", "k.label"), ("w.pop", "k.size")}
    edges = spark.createDataFrame([("a", "label", 1, "City", 1.0), ("b", "country", 1, "City", 0.5), ("c", "label", 2, "City", 1.0), ("d", "year", 3, "Film", 0.7), ("a", "title", 1, "Film", 0.2)], "l string, r string, `table` int, class string, score double")
    assert {r.l for r in knowledge.label_mapped(edges).collect()} == {"a", "b", "c"}
    keys = spark.createDataFrame([("City", ["label", "country"])], "class string, cols array<string>")
    assert {(r["table"], r["class"]) for r in knowledge.keys_mapped(edges, keys).collect()} == {(1, "City"), (3, "Film"), (1, "Film")}
    columns = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", False)], "col_id string, is_context boolean")
    assert {r.l for r in knowledge.without_context_labels(edges, columns).collect()} == {"a", "b", "c", "d"} and knowledge.without_context_labels(edges, columns).count() == 4
    inclusions = spark.createDataFrame([("City", ["name"], "Film", ["title"])], "class1 string, attrs1 array<string>, class2 string, attrs2 array<string>")
    tables = spark.createDataFrame([(1, "City"), (1, "Film"), (2, "City")], "`table` int, class string")
    assert [tuple(r) for r in knowledge.excluded_keys(inclusions, tables).collect()] == [(1, "City", ["name"])]
    clusters = spark.createDataFrame([("a", "x"), ("c", "x"), ("b", "y"), ("d", "z")], "col_id string, cluster string")
    assert {(r["table"], r["class"], r.l, r.r) for r in knowledge.consistent(edges, clusters).collect()} == {(1, "City", "a", "label"), (1, "City", "b", "country"), (2, "City", "c", "label"), (3, "Film", "d", "year")}
    links = spark.createDataFrame([("w1", "k1")], "l string, r string")
    values = spark.createDataFrame([("w1", "pop", "10")], "id string, column string, v string")
    props = spark.createDataFrame([("k1", "size", "20")], "id string, property string, v string")
    kinds = spark.createDataFrame([("pop", "size", "numeric")], "column string, property string, type string")
    assert [(r.l, r.r, r.score) for r in knowledge.duplicate_based(links, values, props, kinds).collect()] == [("pop", "size", 0.5)]
    people = spark.createDataFrame([("k1", "Film", "Alien (1979 film)"), ("k2", "Film", "Heat (Mann)"), ("k3", "Film", "Up")], "id string, class string, label string")
    held = spark.createDataFrame([("k2", "director", "Mann")], "id string, property string, value string")
    assert {(r.what, r.share) for r in knowledge.disambiguation_profile(people, held).collect()} == {("year", 0.5), ("class name", 0.5), ("director", 0.5)}
    kb2 = spark.createDataFrame([("k1", "City", "name", "Rome (Italy)"), ("k0", "City", "name", "Rome")], "id string, class string, property string, value string")
    assert [tuple(r) for r in knowledge.class_extract(kb2, "City", "name").collect()] == [("Rome", "k0")]


def test_learned_linkage(spark):
    web = spark.createDataFrame([(f"w{i}", f"name {i} alpha") for i in range(30)], "id string, label string")
    kb = spark.createDataFrame([(f"k{i}", f"name {i}") for i in range(30)], "id string, label string")
    gold = spark.createDataFrame([(f"w{i}", f"k{i}") for i in range(30)], "l string, r string")
    pairs = spark.createDataFrame([(f"w{i}", f"k{(i + j) % 30}") for i in range(30) for j in (1, 2, 3)], "l string, r string")
    features = knowledge.linkage_features(pairs, web, kb, gold)
    assert features.count() == 120
    scored = knowledge.learned_rule(features, ["jaccard", "edits"]).transform(features)
    assert scored.where("prediction = label").count() == 120


def test_more_matching(spark):
    edges = spark.createDataFrame([("1a", "2a", 1, 2), ("1b", "2b", 1, 2), ("2a", "3a", 2, 3), ("2b", "3b", 2, 3)], "l string, r string, l_table int, r_table int")
    dets = spark.createDataFrame([(1, ["1a", "1b"]), (3, ["3a"])], "table_id int, cols array<string>")
    assert {(r.table_id, tuple(r.cols)) for r in matching.propagated_determinants(dets, edges).collect()} == {(1, ("1a",)), (2, ("2a",)), (3, ("3a",))}
    columns = spark.createDataFrame([(1, "1a", "name", False, "string", "c"), (1, "1b", "uri 0", True, "string", "c"), (2, "2a", "name", False, "string", "c"), (2, "2b", "uri 0", True, "string", "c"), (3, "3a", "title", False, "string", "d")], "table_id int, col_id string, header string, is_context boolean, type string, cluster string")
    assert {(r.l, r.r) for r in matching.context_edges(columns).collect()} == {("1b", "2b")}
    own = spark.createDataFrame([("1a", "2a")], "l string, r string")
    more = spark.createDataFrame([("1b", "2b"), ("1a", "3a")], "l string, r string")
    assert {(r.l, r.r) for r in matching.merged_context_edges(own, more, columns).collect()} == {("1a", "2a"), ("1b", "2b")}
    assert {(r.l, r.r) for r in matching.matched(None, columns, spark.createDataFrame([("2a", "3a")], "l string, r string")).collect()} == {("1a", "2a"), ("1a", "3a"), ("2a", "3a")}
    cells = spark.createDataFrame([(1, "r1", "1a", "x"), (1, "r2", "1a", None)], "table_id int, row_id string, col_id string, v string")
    assert [tuple(r) for r in matching.cell_keys(cells, "1a").collect()] == [("r1", "1~x")]
    held = spark.createDataFrame([("r1", "City", "name", "New York"), ("r1", "City", "country", "US"), ("r2", "City", "name", "Rome")], "row_id string, class string, property string, v string")
    keys = spark.createDataFrame([("City", ["name", "country"])], "class string, cols array<string>")
    assert {(r.token, r.n) for r in matching.full_key_entities(held, keys).collect()} == {("us", 1), ("new", 1), ("york", 1)}


def test_more_stitching_and_scores(spark, site):
    frames = {t.url: t.rows for t in site[:4]}
    unions = stitching.clustered_union(frames, {u: u.split("/")[3] for u in frames})
    assert set(unions) == {("north", "state+profession+employment"), ("south", "state+profession+employment")}
    columns = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "table_id int, col_id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.0)], "l string, r string, score double")
    assert {tuple(r) for r in stitching.entity_groups(edges.where("score > 0"), columns).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {tuple(r) for r in evaluation.edges_to_gold(edges).collect()} == {("a", "a"), ("b", "a")}
    kb = spark.createDataFrame([("k", "size", "9")], "id string, property string, value string")
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "id string, n int")
    links = spark.createDataFrame([("r1", "k")], "l string, r string")
    assert {(r.id, r["size"]) for r in stitching.annotated(rows, links, kb, ["size"]).collect()} == {("r1", "9"), ("r2", None)}
    weights = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 1.0), ("c", "y", 4.0)], "id string, cluster string, weight double")
    assert evaluation.weighted_pairwise(weights, edges).first()[0] == round(2 / 6, 6)


def test_arriving_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text(json.dumps({"url": "u", "header": ["a"], "rows": rows}))
    put("1.json", [["x"], [None]])
    run = lambda: arrivals.appended(arrivals.arriving_cells(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    put("2.json", [["y"]])
    run()
    cells = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(r.v) for r in cells.collect()) == ["None", "x", "y"]
    assert {(r.n, r.filled) for r in arrivals.running_density(cells).collect()} == {(2, 1), (1, 1)}


def test_columns_that_look_alike_keep_their_names():
    assert synthesis.safe_names(["a b", "a_b", "a-b", "c"]) == {"a b": "a_b", "a_b": "a_b_2", "a-b": "a_b_3", "c": "c"}


@pytest.mark.parametrize("matcher", ["label", "value"])
def test_whole_workflow(spark, matcher):
    """Two layouts of one kind of table, on pages by year, become entities and relations with foreign keys."""
    states = [f"state {i}" for i in range(6)]
    jobs = [f"job {i}" for i in range(4)]
    tables = []
    for y in (2001, 2002):
        rows = [(s, j, f"cap of {s}", f"{y}{i}{k}") for i, s in enumerate(states) for k, j in enumerate(jobs)]
        tables.append(synthesis.WebTable(f"http://s/first/{y}", spark.createDataFrame(rows, "state string, profession string, capital string, employment string"), "T"))
        names = "state string, profession string, capital string, employment string" if matcher == "label" else "area string, profession string, town string, workers string"
        other = spark.createDataFrame(rows[4:], names)
        tables.append(synthesis.WebTable(f"http://s/second/{y}", other.select(*reversed(other.columns)), "T"))
    config = synthesis.Config(matcher=matcher, filter="both", entities={"State": ["state"]}, max_size=3)
    site = synthesis.normalise_web_tables(tables, config)
    assert len(site.tables) == 2 and len(site.stitched) == 1
    df = next(iter(site.stitched.values()))
    assert {"state", "profession", "capital", "employment"} <= set(df.columns) and df.select("state", "profession", "employment").distinct().count() == 48
    assert site.entities["State"].count() == 6
    relations = next(iter(site.relations.values()))
    assert all("FK" in r.columns for r in relations.values())
    assert relations["FK"].select("FK", "capital").distinct().count() == 6
    assert any({"FK", "profession", "employment"} <= set(r.columns) and r.count() == 48 for r in relations.values())
    assert [name for depth, name, _ in site.timings.lines if depth == 0] == ["matching", "stitching", "normalisation"]


def test_tables_are_matched_to_classes(spark):
    cities = [(f"c{i}", f"city {w} {i}", f"{1000 * i + 17}") for i, w in enumerate("alpha beta gamma delta epsilon zeta".split())]
    people = [(f"p{i}", f"person {w}", f"{20 + i}") for i, w in enumerate("alpha beta gamma delta".split())]
    kb_rows = [("City", i, p, t, v) for i, n, x in cities for p, t, v in (("label", "string", n), ("population", "numeric", x))]
    kb_rows += [("Person", i, p, t, v) for i, n, x in people for p, t, v in (("label", "string", n), ("age", "numeric", x))]
    kb = spark.createDataFrame(kb_rows, "class string, id string, property string, type string, v string")
    web_rows = [("1", f"r{k}", c, t, v) for k, (_, n, x) in enumerate(cities[:5]) for c, t, v in (("1a", "string", n), ("1b", "numeric", x))]
    web = spark.createDataFrame(web_rows, "table string, id string, column string, type string, v string")
    clusters = spark.createDataFrame([("1a", 0), ("1b", 1)], "col_id string, cluster int")
    keys = spark.createDataFrame([("City", ["label"]), ("Person", ["label", "age"])], "class string, cols array<string>")
    columns, links = knowledge.matched_to_classes(web, kb, clusters, keys)
    assert {(r["table"], r["class"], r["l"], r["r"]) for r in columns.collect()} == {("1", "City", "1a", "label"), ("1", "City", "1b", "population")}
    assert {(r["l"], r["r"]) for r in links.collect()} == {(f"r{k}", f"c{k}") for k in range(5)}
