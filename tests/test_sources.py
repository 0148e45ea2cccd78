import gzip
import json

from stitchwork.sources import files


def test_web_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    table = lambda h, rows: json.dumps({"url": "http://s/a/1", "title": "t", "heading": "h", "header": h, "rows": rows}, indent=1)
    (tmp_path / "t_7.json").write_text(table(["a", "b"], [["1", None], ["2", "x"]]))
    (tmp_path / "sub/other.json").write_text(table(["a"], [["3"]]))
    (tmp_path / "sub/u_7.json").write_text(table(["a"], []))
    tables = files.web_tables(spark, str(tmp_path))
    assert {(r.row_id, r.ord, r.v) for r in files.cells(tables).collect()} == {(0, 0, "1"), (0, 1, None), (1, 0, "2"), (1, 1, "x"), (0, 0, "3")}
    assert files.columns(tables).select("col_id").distinct().count() == 4
    ids = sorted(r.table_id for r in files.table_ids(tables.select("path")).collect())
    assert ids == [7, 8, 9]
    (tmp_path / "c.csv").write_text("h,i\n1,\n")
    assert {(r.row_id, r.ord, r.v) for r in files.csv_tables(spark, str(tmp_path)).collect()} == {(0, 0, "h"), (0, 1, "i"), (1, 0, "1"), (1, 1, None)}


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "h.tsv").write_text('"http://x/City"\t"http://x/Place"\n"http://x/Place"\t"http://x/Thing"\n')
    h = files.class_hierarchy(spark, str(tmp_path / "h.tsv"))
    assert {tuple(r) for r in h.collect()} == {("City", "Place"), ("Place", "Thing")}
    (tmp_path / "City.csv").write_text("URI,label,mayor,mayor_label\nu1,Rome,m1,Bob\n")
    with gzip.open(tmp_path / "Place.csv.gz", "wt") as f:
        f.write("URI,label,size\nu1,Rome,5\nu2,Alps,9\n")
    kb = files.knowledge_base(spark, {"City": str(tmp_path / "City.csv"), "Place": str(tmp_path / "Place.csv.gz")}, h)
    assert {(r.uri, r["class"], r.property, r.value) for r in kb.collect()} == {("u1", "City", "mayor_label", "Bob"), ("u2", "Place", "size", "9")}


def test_metadata_files(spark, tmp_path):
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys/City.csv").write_text("name,country\nuri\n")
    assert {(r["class"], tuple(r.cols)) for r in files.candidate_keys(spark, str(tmp_path / "keys")).collect()} == {("City", ("name", "country")), ("City", ("uri",))}
    (tmp_path / "ind").write_text("A\ta,b\tB\tc\t0.5\nbroken\tline\n")
    assert [(r.class1, r.attrs1, r.attrs2, r.score) for r in files.inclusion_dependencies(spark, str(tmp_path / "ind")).collect()] == [("A", ["a", "b"], ["c"], 0.5)]
    (tmp_path / "forms").write_text("Rome\tRoma\tUrbs\nX\n")
    (tmp_path / "redirects").write_text("Rome\tRom\n\tblank\n")
    assert {r.label: r.aliases for r in files.surface_forms(spark, str(tmp_path / "forms"), str(tmp_path / "redirects")).collect()} == {"Rome": ["Rom", "Roma", "Urbs"]}
    (tmp_path / "defs").write_text("city\tname,country\t[c1, c2]\n")
    assert files.definitions(spark, str(tmp_path / "defs")).first().lists == [["name", "country"], ["c1", "c2"]]
    (tmp_path / "gold.tsv").write_text("a\t1,2\nb\t3\n")
    (tmp_path / "gold.txt").write_text("a\n1\n2\n\nb\n3\n")
    for name in ("gold.tsv", "gold.txt"):
        gold = files.gold_clusters(spark, str(tmp_path / name))
        assert {tuple(r) for r in gold.collect()} == {("a", "1"), ("a", "2"), ("b", "3")}
        assert [tuple(r) for r in files.gold_pairs(gold).collect()] == [("1", "2")]
    files.write_clusters(gold, str(tmp_path / "out"))
    assert {tuple(r) for r in files.gold_clusters(spark, str(tmp_path / "out")).collect()} == {("a", "1"), ("a", "2"), ("b", "3")}


def test_writers(spark, tmp_path):
    idf = spark.createDataFrame([("a", 0.5)], "token string, idf double")
    files.write_idf(idf, str(tmp_path / "idf"))
    assert files.read_idf(spark, str(tmp_path / "idf")).collect() == idf.collect()
    edges = spark.createDataFrame([("x", "y", 0.5)], "l string, r string, score double")
    files.write_graph(edges, str(tmp_path / "net"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "net")).collect()] == ["*Vertices 2", '1 "x"', '2 "y"', "*Edges", "1 2 0.5"]
    for kind in ("json", "csv", "parquet"):
        files.write_relation(edges, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.json(str(tmp_path / "json")).count() == 1
    files.write_report(edges, str(tmp_path / "report"))
    files.write_report(edges, str(tmp_path / "report"), append=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["x\ty\t0.5"] * 2
    (tmp_path / "r.csv").write_text("1,?,3\n4,5\n7,8,9\n")
    df = files.numbered_relation(spark, str(tmp_path / "r.csv"), null="?", hidden=(2,))
    assert df.columns == ["0", "1"] and {tuple(r) for r in df.collect()} >= {("1", None), ("7", "8")}


def test_services(spark):
    """A18, by a function in place of the network."""
    from stitchwork.sources import services

    def fetch(url):
        if "down" in url:
            raise OSError("no route")
        if "sparql" in url:
            return '{"results": {"bindings": [{"abstract": {"value": "a town"}}]}}'
        return '{"results": [{"uri": "http://x/Paris"}, {"uri": "http://x/Paris_2"}]}' if "Paris" in url else '{"results": []}'

    words = spark.createDataFrame([("Paris",), ("Paris",), ("down",), ("none & more",), (None,)], "word string")
    rows = sorted((r.word or "", r.uri or "", r.error or "") for r in services.looked_up(words, "word", "http://lookup", 5, fetch).collect())
    assert rows == [("", "", ""), ("Paris", "http://x/Paris", ""), ("Paris", "http://x/Paris_2", ""), ("down", "", "no route"), ("none & more", "", "")]
    found = services.abstracts(spark.createDataFrame([("http://x/Paris",)], "uri string"), "uri", "http://sparql", fetch).collect()
    assert [(r.uri, r.abstract) for r in found] == [("http://x/Paris", "a town")]


def test_numbers_in_an_order(spark):
    from stitchwork.operators import ranking

    rows = ranking.row_numbers(spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(9), ["v"], "n", 5).collect()
    assert {r.v: r.n for r in rows} == {v: v + 5 for v in range(1000)}
