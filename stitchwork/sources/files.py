"""Reading and writing of tables, knowledge bases, keys and gold standards."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stitchwork.operators import ranking


def web_tables(spark: SparkSession, folder: str) -> DataFrame:
    """JSON tables below a folder: path, url, title, heading, header (array), rows (array of arrays)."""
    schema = "url string, title string, heading string, header array<string>, rows array<array<string>>"
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.input_file_name())


def csv_tables(spark: SparkSession, folder: str) -> DataFrame:
    """CSV tables below a folder as cells (path, row_id, ord, v), the first line being row 0, quoted fields with commas, quotes
    and line feeds among them; empty cells are null and empty lines no rows. A file is one row here, as the tables are small and many."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["value"], strict=True):
                lines = [row for row in csv.reader(io.StringIO(content, newline="")) if row]
                yield pd.DataFrame([(path, i, j, v or None) for i, row in enumerate(lines) for j, v in enumerate(row)], columns=["path", "row_id", "ord", "v"])

    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return texts.mapInPandas(parsed, "path string, row_id int, ord int, v string")


def table_ids(paths: DataFrame, first: int = 0) -> DataFrame:
    """(path, table_id): the digits of a file's name if free and not below the first id, else the next free one, in order of paths."""
    digits = F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).try_cast("int")
    named = paths.select("path").distinct().withColumn("d", digits)
    claim = F.row_number().over(Window.partitionBy("d").orderBy("path"))
    named = named.withColumn("own", F.when((F.col("d") >= first) & (claim == 1), F.col("d")))
    top = named.agg(F.coalesce(F.max("own"), F.lit(first - 1))).first()[0]
    rest = ranking.row_numbers(named.where("own is null").select("path"), ["path"], "table_id", top + 1)
    return named.where("own is not null").select("path", F.col("own").cast("long").alias("table_id")).unionByName(rest)


def cells(tables: DataFrame) -> DataFrame:
    """(path, row_id, ord, v) of tables read by web_tables()."""
    rows = tables.select("path", F.posexplode("rows").alias("row_id", "row"))
    return rows.select("path", "row_id", F.posexplode("row").alias("ord", "v"))


def columns(tables: DataFrame) -> DataFrame:
    """(path, ord, col_id, header) of tables read by web_tables(); ids are given once and stay."""
    return tables.select("path", F.posexplode("header").alias("ord", "header")).withColumn("col_id", F.concat("path", F.lit("~Col"), F.col("ord").cast("string")))


def class_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent), the last segments of their URIs."""
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, '"', ""), "/"), -1)
    return spark.read.schema("c string, p string").option("sep", "\t").option("quote", "").csv(path).select(last("c").alias("child"), last("p").alias("parent"))


def knowledge_base(spark: SparkSession, files: dict[str, str], hierarchy: DataFrame | None = None) -> DataFrame:
    """(uri, label, class, property, value) of one CSV (or CSV.gz) for each class, the first two columns being URI and label. A
    property with a twin of labels is left out; a URI of several classes has its most specific one."""
    parts = None
    for name, path in files.items():
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        uri, label, *props = df.columns
        props = [p for p in props if f"{p}_label" not in props]
        rows = df.select(F.col(uri).alias("uri"), F.col(label).alias("label"), F.lit(name).alias("class"), *(F.col(p).cast("string").alias(p) for p in props))
        rows = rows.unpivot(["uri", "label", "class"], props, "property", "value") if props else rows.select("*", F.lit(None).cast("string").alias("property"), F.lit(None).cast("string").alias("value"))
        parts = rows if parts is None else parts.unionByName(rows)
    if hierarchy is not None:
        from stitchwork.operators.graph import superclasses

        depth = superclasses(hierarchy).groupBy("child").agg(F.max("depth").alias("depth"))
        ranked = parts.join(depth, F.col("class") == F.col("child"), "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
        best = ranked.groupBy(F.col("uri").alias("u")).agg(F.max(F.struct("depth", "class")).alias("best"))
        parts = ranked.join(best, (F.col("uri") == F.col("u")) & (F.col("class") == F.col("best.class"))).drop("u", "best", "child", "depth")
    return parts


def candidate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(class, cols): a file for each class, a key on each line."""
    lines = spark.read.text(folder).where("trim(value) != ''")
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[a-z]+$", 1).alias("class"), F.split("value", ",").alias("cols"))


def inclusion_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exactly five fields."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == 5)
    f = lambda i: F.col("f")[i]
    return parts.select(f(0).alias("class1"), F.split(f(1), ",").alias("attrs1"), f(2).alias("class2"), F.split(f(3), ",").alias("attrs2"), f(4).try_cast("double").alias("score"))


def surface_forms(spark: SparkSession, forms: str, redirects: str | None = None) -> DataFrame:
    """(label, aliases): all aliases of a label, redirects among them."""
    lines = spark.read.text(forms).select(F.split("value", "\t").alias("f"))
    long = lines.select(F.col("f")[0].alias("label"), F.explode(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))).alias("alias"))
    if redirects:
        more = spark.read.text(redirects).select(F.split("value", "\t").alias("f")).select(F.col("f")[0].alias("label"), F.get("f", F.lit(1)).alias("alias"))
        long = long.unionByName(more)
    return long.where("trim(label) != '' and trim(alias) != ''").groupBy("label").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(entity, lists): tab-separated lines whose further fields are lists of names, bracketed or not."""
    lines = spark.read.text(path).where("value != ''").select(F.split("value", "\t").alias("f"))
    names = F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x: F.filter(F.split(F.regexp_replace(x, r"[\[\]]", ""), r",\s*"), lambda n: n != ""))
    return lines.select(F.col("f")[0].alias("entity"), names.alias("lists"))


def gold_clusters(spark: SparkSession, path: str) -> DataFrame:
    """A10: (cluster, id) of name<tab>id,id,... lines, or, in .txt files, of blocks between empty lines whose first line is the name."""
    if path.endswith(".txt"):
        blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\s*\n")).alias("b"))
        lines = blocks.select(F.filter(F.split("b", r"\s*\n"), lambda x: F.trim(x) != "").alias("x")).where(F.size("x") > 1)
        return lines.select(F.col("x")[0].alias("cluster"), F.explode(F.slice("x", 2, F.size("x") - 1)).alias("id"))
    lines = spark.read.text(path).where("value != ''").select(F.split("value", "\t").alias("x"))
    return lines.select(F.col("x")[0].alias("cluster"), F.explode(F.split(F.col("x")[1], ",")).alias("id"))


def gold_pairs(clusters: DataFrame) -> DataFrame:
    """(l, r) of all pairs of members, l < r."""
    other = clusters.select(F.col("cluster").alias("c"), F.col("id").alias("r"))
    return clusters.join(other, (F.col("cluster") == F.col("c")) & (F.col("id") < F.col("r"))).select(F.col("id").alias("l"), "r")


def write_clusters(clusters: DataFrame, path: str) -> None:
    """A10: name<tab>id,id,..."""
    line = F.concat_ws("\t", "cluster", F.array_join(F.array_sort(F.collect_set("id")), ","))
    clusters.groupBy("cluster").agg(line.alias("value")).select("value").write.mode("overwrite").text(path)


def write_relation(df: DataFrame, path: str, kind: str = "json") -> None:
    """A12, A13."""
    (df.write.mode("overwrite").option("header", True) if kind == "csv" else df.write.mode("overwrite")).format(kind).save(path)


def write_report(df: DataFrame, path: str, append: bool = False) -> None:
    """Tab-separated, no header."""
    df.write.mode("append" if append else "overwrite").option("sep", "\t").csv(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """A graph in the .net format: *Vertices n, a line for each, *Edges, a line for each of (l, r, score)."""
    nodes = ranking.row_numbers(edges.select(F.col("l").alias("node")).union(edges.select("r")).distinct(), ["node"], "i", 1)
    number = lambda x: nodes.select(F.col("node").alias(x), F.col("i").alias(f"{x}_i"))
    n = nodes.count()
    head = edges.sparkSession.createDataFrame([(0, 0, f"*Vertices {n}"), (2, 0, "*Edges")], "part int, i long, value string")
    vertices = nodes.select(F.lit(1).alias("part"), "i", F.format_string('%d "%s"', "i", "node").alias("value"))
    lines = edges.join(number("l"), "l").join(number("r"), "r").select(F.lit(3).alias("part"), F.col("l_i").alias("i"), F.format_string("%d %d %s", "l_i", "r_i", F.col("score").cast("string")).alias("value"))
    head.unionByName(vertices).unionByName(lines).orderBy("part", "i", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    """A16."""
    return spark.read.schema("token string, idf double").option("sep", "\t").csv(path)


def write_idf(idf: DataFrame, path: str) -> None:
    """A16."""
    idf.select("token", "idf").write.mode("overwrite").option("sep", "\t").csv(path)


def numbered_relation(spark: SparkSession, path: str, null: str = "", ragged: str = "DROPMALFORMED", hidden: tuple[int, ...] = ()) -> DataFrame:
    """A CSV as strings with columns named 0, 1, ..., one value read as null, ragged lines dropped (or FAILFAST), some columns hidden."""
    first = spark.read.option("header", False).csv(path)
    schema = ", ".join(f"`{i}` string" for i in range(len(first.columns)))
    df = spark.read.schema(schema).option("header", False).option("nullValue", null).option("mode", ragged).csv(path)
    return df.drop(*(str(i) for i in hidden))
