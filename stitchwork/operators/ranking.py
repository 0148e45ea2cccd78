"""Top rows of groups and one-to-one assignments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """F03."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def row_numbers(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """Rows numbered in an order, without bringing them to one task: sorted by ranges, numbered in each, and moved on by the sizes of the
    ranges before, of which there are as many as partitions."""
    from stitchwork.operators.graph import _cut

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = _cut(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    sizes = sorted((r["__part"], r["count"]) for r in marked.groupBy("__part").count().collect())
    before, total = [], first
    for part, n in sizes:
        before.append((part, total))
        total += n
    begins = df.sparkSession.createDataFrame(before, "p int, begin long")
    return marked.join(begins, F.col("__part") == F.col("p")).withColumn(name, F.col("begin") + F.col("__at")).drop("__part", "__at", "p", "begin")


def mutual_best(edges: DataFrame, by: list[str] = ["l_table", "r_table"]) -> DataFrame:  # noqa: B006
    """edges that are the best of both their ends within a pair of tables; ties go to the smaller id."""
    rank = lambda end, other: F.row_number().over(Window.partitionBy(*by, end).orderBy(F.desc("score"), other))
    return edges.withColumn("__l", rank("l", "r")).withColumn("__r", rank("r", "l")).where("__l = 1 and __r = 1").drop("__l", "__r")


def greedy(edges: list[tuple]) -> list[tuple]:
    """Edges (l, r, score) by falling score whose ends are both free."""
    left, right, out = set(), set(), []
    for l, r, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):  # noqa: E741
        if l not in left and r not in right:
            left.add(l)
            right.add(r)
            out.append((l, r, s))
    return out


def assignment(scores: list[list[float]]) -> list[int]:
    """Maximum-weight matching of rows to columns: for each row its column or -1 (weight 0 is no match). Shortest augmenting paths."""
    n = max(len(scores), len(scores[0]) if scores else 0)
    cost = [[-(scores[i][j] if i < len(scores) and j < len(scores[i]) else 0.0) for j in range(n)] for i in range(n)]
    row_price, col_price, match = [0.0] * n, [0.0] * n, [-1] * n
    for root in range(n):
        dist, back, done = [float("inf")] * n, [-1] * n, [False] * n
        row, col = root, -1
        while True:
            base = 0.0 if col < 0 else dist[col]
            for j in range(n):
                if not done[j]:
                    d = base + cost[row][j] - row_price[row] - col_price[j]
                    if d < dist[j] - 1e-12:
                        dist[j], back[j] = d, col
            col = min((j for j in range(n) if not done[j]), key=dist.__getitem__)
            done[col] = True
            if match[col] < 0:
                break
            row = match[col]
        end = dist[col]
        for j in range(n):
            if done[j] and j != col:
                row_price[match[j]] += end - dist[j]
                col_price[j] -= end - dist[j]
        row_price[root] += end
        while col >= 0:
            before = back[col]
            match[col] = match[before] if before >= 0 else root
            col = before
    out = [-1] * len(scores)
    for j, i in enumerate(match):
        if 0 <= i < len(scores) and j < len(scores[i]) and scores[i][j] > 0:
            out[i] = j
    return out


def _per_group(edges: DataFrame, by: list[str], choose) -> DataFrame:
    schema = edges.select(*by, "l", "r", "score").schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = choose(list(zip(pdf["l"], pdf["r"], pdf["score"], strict=True)))
        out = pd.DataFrame(chosen, columns=["l", "r", "score"])
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "l", "r", "score"]]

    return edges.groupBy(*by).applyInPandas(run, schema)


def greedy_one_to_one(edges: DataFrame, by: list[str]) -> DataFrame:
    """of each pair of sources the edges by falling score whose ends are both free. Groups are columns of two tables, hence small."""
    return _per_group(edges, by, greedy)


def maximum_matching(edges: DataFrame, by: list[str]) -> DataFrame:
    """of each pair of sources the one-to-one edges with the largest sum of scores."""

    def choose(rows: list[tuple]) -> Iterator[tuple]:
        best: dict[tuple, float] = {}
        for l, r, s in rows:  # noqa: E741
            best[l, r] = max(s, best.get((l, r), 0.0))
        left, right = sorted({l for l, _ in best}), sorted({r for _, r in best})  # noqa: E741
        found = assignment([[best.get((l, r), 0.0) for r in right] for l in left])  # noqa: E741
        return [(left[i], right[j], best[left[i], right[j]]) for i, j in enumerate(found) if j >= 0]

    return _per_group(edges, by, choose)


def block_filter(blocks: DataFrame, ratio: float) -> DataFrame:
    """blocks (block, size) that are not larger than the one at the ratio of all, by size."""
    n = blocks.count()
    at = max(0, int(n * ratio) - 1)
    limit = blocks.orderBy("size").select("size").offset(at).limit(1).first()
    return blocks.where(F.col("size") <= limit[0]) if limit else blocks
