"""Graphs of correspondences: components, closures, hierarchies, refinement."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.operators import relational


def folder(spark: SparkSession) -> str:
    """A new folder where the session says that checkpoints go, which driver and executors share; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith(("local-cluster", "spark:", "yarn", "k8s:", "mesos:")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stitchwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stitchwork/{uuid.uuid4().hex}"


def _cut(df: DataFrame, *gone: DataFrame) -> DataFrame:
    """The rows written and read again: cuts the lineage, outlives a lost executor and has sizes as they are. Steps that are gone by then
    are removed."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    for step in gone:
        _forget(step)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def _forget(step: DataFrame) -> None:
    p = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step._step)
    p.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component named by its smallest node. edges: l, r; null ends are left out.

    Each round hooks every node to its smallest neighbour, if that is smaller, and follows the hooks to their ends, by jumps that double in
    length. The graph then shrinks to these ends, so that later rounds join fewer edges, a hub's too, until none is left.
    """
    both = edges.select("l", "r").where("l is not null and r is not null")
    nodes = both.select(F.col("l").alias("node")).union(both.select("r")).distinct()
    labels = _cut(nodes.withColumn("component", F.col("node")))
    known = both.where("l != r")
    left = _cut(known.unionByName(known.select(F.col("r").alias("l"), F.col("l").alias("r"))).distinct())
    while not left.isEmpty():
        hooks = _cut(left.groupBy(F.col("l").alias("n")).agg(F.min("r").alias("least")).select("n", F.least("n", "least").alias("to"), F.lit(True).alias("moved")))
        while not hooks.where("moved").isEmpty():
            beyond = hooks.select(F.col("n").alias("m"), F.col("to").alias("beyond"))
            hooks = _cut(hooks.join(beyond, F.col("to") == F.col("m")).select("n", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")), hooks)
        labels = _cut(labels.join(hooks, F.col("component") == F.col("n"), "left").select("node", F.coalesce("to", "component").alias("component")), labels)
        ends = left.join(hooks, F.col("l") == F.col("n")).select(F.col("to").alias("x"), "r")
        ends = ends.join(hooks, F.col("r") == F.col("n")).select(F.col("x").alias("l"), F.col("to").alias("r"))
        left = _cut(ends.where("l != r").distinct(), left, hooks)
    _forget(left)
    return labels


def closure_pairs(edges: DataFrame) -> DataFrame:
    """All ordered pairs (l, r) of different nodes of a component."""
    c = components(edges)
    other = c.select(F.col("node").alias("r"), F.col("component").alias("rc"))
    return c.join(other, (F.col("component") == F.col("rc")) & (F.col("node") != F.col("r"))).select(F.col("node").alias("l"), "r")


def missing_transitive_edges(edges: DataFrame) -> DataFrame:
    """Pairs (l, r), l < r, that follow from the edges and are no edges."""
    known = edges.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"))
    return closure_pairs(edges).where("l < r").join(known, ["l", "r"], "left_anti")


def superclasses(hierarchy: DataFrame) -> DataFrame:
    """(child, ancestor, depth) of a hierarchy (child, parent), as deep as it goes; one with a cycle is refused."""
    out = step = _cut(hierarchy.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    up = hierarchy.select(F.col("child").alias("c"), "parent")
    depth = 1
    while not step.isEmpty():
        if not step.where("child = ancestor").isEmpty():
            raise ValueError("the class hierarchy has a cycle")
        depth += 1
        step = _cut(step.join(up, F.col("ancestor") == F.col("c")).select("child", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")))
        out = out.unionByName(step)
    return out


def propagated_scores(scores: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(col, class, score) with each class's scores added to its superclasses."""
    up = superclasses(hierarchy).select(F.col("child").alias("c"), "ancestor")
    lifted = scores.join(up, F.col("class") == F.col("c")).select("col", F.col("ancestor").alias("class"), "score")
    return scores.unionByName(lifted).groupBy("col", "class").agg(F.round(F.sum("score"), 6).alias("score"))


def corrected_scores(scores: DataFrame, hierarchy: DataFrame, factor: float = 0.5) -> DataFrame:
    """Each scored class gets its nearest scored superclass's score times the factor on top."""
    up = superclasses(hierarchy).select(F.col("child").alias("c"), "ancestor", "depth")
    above = scores.select(F.col("col").alias("k"), F.col("class").alias("a"), F.col("score").alias("upper"))
    near = scores.join(up, F.col("class") == F.col("c")).join(above, (F.col("k") == F.col("col")) & (F.col("a") == F.col("ancestor")))
    near = near.groupBy("col", "class").agg(F.min_by("upper", "depth").alias("upper"))
    return scores.join(near, ["col", "class"], "left").select("col", "class", F.round(F.col("score") + factor * F.coalesce("upper", F.lit(0.0)), 6).alias("score"))


def disjoint_headers(columns: DataFrame) -> DataFrame:
    """(l, r, n) of different headers that stand together in n tables. columns: table_id, header."""
    c = columns.where("header is not null and header != 'null'").distinct()
    other = c.select(F.col("table_id").alias("t"), F.col("header").alias("r"))
    return c.join(other, (F.col("table_id") == F.col("t")) & (F.col("header") < F.col("r"))).groupBy(F.col("header").alias("l"), "r").agg(F.count("*").alias("n"))


def paired(items: DataFrame, name: str, within: list[str]) -> DataFrame:
    """(l, r): all pairs of names of some group, one with itself too. A name counts once in its group, however many rows have it."""
    own = items.select(F.col(name).alias("l"), *within).distinct()
    return relational.all_pairs(own, own.withColumnRenamed("l", "r"), within).select("l", "r").distinct()


def header_synonyms(edges: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(header, cluster) of headers joined by matches, without pairs that stand together in a table. edges: l, r (headers)."""
    named = edges.where("l != r").select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    return components(named.join(disjoint.select("l", "r"), ["l", "r"], "left_anti")).select(F.col("node").alias("header"), F.col("component").alias("cluster"))


# small graphs, on one machine


def signed_clusters(edges: list[tuple]) -> list[set]:
    """Clusters of (l, r, weight): the strongest positive pair of clusters merges, unless a negative edge lies between them."""
    cluster = {n: n for l, r, _ in edges for n in (l, r)}  # noqa: E741
    members = {n: {n} for n in cluster}
    enemies = defaultdict(set)
    for l, r, w in edges:  # noqa: E741
        if w < 0:
            enemies[l].add(r)
            enemies[r].add(l)
    queue = [(-w, min(l, r), max(l, r)) for l, r, w in edges if w > 0]  # noqa: E741
    heapq.heapify(queue)
    while queue:
        _, l, r = heapq.heappop(queue)  # noqa: E741
        a, b = cluster[l], cluster[r]
        if a == b or any(e in members[b] for m in members[a] for e in enemies[m]):
            continue
        keep, gone = min(a, b), max(a, b)
        for m in members.pop(gone):
            cluster[m] = keep
            members[keep].add(m)
    return sorted(members.values(), key=lambda s: min(s))


def complete_link(pairs: list[tuple], threshold: float) -> list[set]:
    """Clusters of (a, b, similarity) whose least similar pair reaches the threshold, merged most similar first."""
    sim = {}
    for a, b, s in pairs:
        sim[a, b] = sim[b, a] = s
    clusters = [frozenset([n]) for n in sorted({n for a, b, _ in pairs for n in (a, b)})]
    while True:
        best = max(((min(sim.get((x, y), 0.0) for x in p for y in q), -i, -j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j), default=None)
        if best is None or best[0] < threshold:
            return [set(c) for c in clusters]
        i, j = -best[1], -best[2]
        merged = clusters[i] | clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [merged]


def _paths(graph: dict, source) -> tuple[dict, dict, list]:
    count, before, order, dist = defaultdict(int, {source: 1}), defaultdict(list), [], {source: 0}
    queue = deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in sorted(graph[v]):
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
            if dist[w] == dist[v] + 1:
                count[w] += count[v]
                before[w].append(v)
    return count, before, order


def edge_betweenness(graph: dict) -> dict:
    """Shares of shortest paths through each edge (smaller node first)."""
    out = defaultdict(float)
    for s in sorted(graph):
        count, before, order = _paths(graph, s)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                part = count[v] / count[w] * (1 + share[w])
                out[min(v, w), max(v, w)] += part / 2
                share[v] += part
    return out


def refine(edges: list[tuple], table: dict, header: dict, disjoint: set, context: set = frozenset()) -> list[tuple]:
    """Edges (l, r) that stay. While two nodes of a component conflict (headers that stand together in a table, or two columns of one
    table), an edge on their shortest path goes: context edges first, then of largest betweenness, edges of equal headers only where
    their tables are the same. With an edge go all that join the same pair of different headers."""
    left = {(min(e), max(e)) for e in edges}

    def clash(a, b) -> bool:
        return table[a] == table[b] or frozenset((header[a], header[b])) in disjoint

    changed = True
    while changed:
        changed = False
        graph = defaultdict(set)
        for a, b in left:
            graph[a].add(b)
            graph[b].add(a)
        for a in sorted(graph):
            _, before, order = _paths(graph, a)
            b = next((x for x in order if x != a and clash(a, x)), None)
            if b is None:
                continue
            path, at = [], b
            while at != a:
                step = min(before[at])
                path.append((min(at, step), max(at, step)))
                at = step
            between = edge_betweenness(graph)
            can = [e for e in path if header[e[0]] != header[e[1]] or table[e[0]] == table[e[1]]] or path
            gone = max(can, key=lambda e: (e[0] in context or e[1] in context, between[e], e))
            names = frozenset((header[gone[0]], header[gone[1]]))
            left -= {gone} | ({e for e in left if frozenset((header[e[0]], header[e[1]])) == names} if len(names) == 2 else set())
            changed = True
            break
    return sorted(left)


def refined(edges: DataFrame, nodes: DataFrame, disjoint: DataFrame) -> DataFrame:
    """H10 for each component of edges (l, r) in a task of its own. nodes: col_id, table_id, header; disjoint: l, r (headers)."""
    component = components(edges)
    clashes = {frozenset((r.l, r.r)) for r in disjoint.select("l", "r").collect()}  # pairs of headers: metadata
    side = lambda x: nodes.select(F.col("col_id").alias(x), F.col("table_id").cast("string").alias(f"{x}_table"), F.col("header").alias(f"{x}_header"))
    rows = edges.select("l", "r").join(side("l"), "l").join(side("r"), "r").join(component, F.col("l") == F.col("node"))
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = dict(zip(pdf["l"], pdf["l_table"])) | dict(zip(pdf["r"], pdf["r_table"]))
        header = dict(zip(pdf["l"], pdf["l_header"])) | dict(zip(pdf["r"], pdf["r_header"]))
        return pd.DataFrame(refine(list(zip(pdf["l"], pdf["r"])), table, header, clashes), columns=["l", "r"])

    return rows.groupBy("component").applyInPandas(run, f"l {kinds['l']}, r {kinds['r']}")
