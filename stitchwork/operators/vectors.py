"""Token vectors of columns or records, and their similarities through an inverted index.

tokens: owner, token, once for each occurrence. Vectors: owner, token, weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors(tokens: DataFrame, weighting: str = "tf") -> DataFrame:
    """Weight 1 (binary) or the count over the owner's number of distinct tokens (tf)."""
    counts = tokens.where("token is not null").groupBy("owner", "token").agg(F.count("*").alias("n"))
    if weighting == "binary":
        return counts.select("owner", "token", F.lit(1.0).alias("weight"))
    distinct = F.count("*").over(Window.partitionBy("owner"))
    return counts.select("owner", "token", (F.col("n") / distinct).alias("weight"))


def idf(*sides: DataFrame) -> DataFrame:
    """(token, df, idf) with df summed over the sides and idf = ln(number of owners / df)."""
    n = sum(s.select("owner").distinct().count() for s in sides)
    df = None
    for s in sides:
        one = s.groupBy("token").agg(F.count("*").alias("df"))
        df = one if df is None else df.unionByName(one)
    return df.groupBy("token").agg(F.sum("df").alias("df")).withColumn("idf", F.ln(F.lit(float(n)) / F.col("df")))


def tf_idf(vector: DataFrame, idf_table: DataFrame) -> DataFrame:
    """Weights times idf; tokens without one weigh 0."""
    return vector.join(idf_table.select("token", "idf"), "token", "left").select("owner", "token", (F.col("weight") * F.coalesce("idf", F.lit(0.0))).alias("weight"))


def dot_products(left: DataFrame, right: DataFrame, block_ratio: float | None = None, max_pairs: int | None = None) -> DataFrame:
    """(l, r, dot, common) over shared tokens. block_ratio drops the blocks of most pairs (F08), a block being a token of both
    sides and its pairs the product of the sides' owners; max_pairs drops blocks of more. Without them, all blocks count."""
    if block_ratio is not None or max_pairs is not None:
        size = lambda v, name: v.groupBy("token").agg(F.count("*").alias(name))
        blocks = size(left, "a").join(size(right, "b"), "token").select(F.col("token").alias("block"), (F.col("a") * F.col("b")).alias("size"))
        if block_ratio is not None:
            from stitchwork.operators.ranking import block_filter

            blocks = block_filter(blocks, block_ratio)
        if max_pairs is not None:
            blocks = blocks.where(F.col("size") <= max_pairs)
        kept = blocks.select(F.col("block").alias("token"))
        left, right = left.join(kept, "token", "left_semi"), right.join(kept, "token", "left_semi")
    a = left.select("token", F.col("owner").alias("l"), F.col("weight").alias("lw"))
    b = right.select("token", F.col("owner").alias("r"), F.col("weight").alias("rw"))
    return a.join(b, "token").where("l != r").groupBy("l", "r").agg(F.sum(F.col("lw") * F.col("rw")).alias("dot"), F.count("*").alias("common"))


def _with(pairs: DataFrame, left: DataFrame, right: DataFrame, measure) -> DataFrame:
    side = lambda v, x: v.groupBy(F.col("owner").alias(x)).agg(measure.alias(f"{x}_size"))
    return pairs.join(side(left, "l"), "l").join(side(right, "r"), "r")


def cosine(left: DataFrame, right: DataFrame, threshold: float = 0.0, block_ratio: float | None = None) -> DataFrame:
    """(l, r, score)."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    scored = _with(dot_products(left, right, block_ratio), left, right, norm).withColumn("score", F.try_divide("dot", F.col("l_size") * F.col("r_size")))
    return scored.where(F.col("score") >= threshold).select("l", "r", "score")


def jaccard(left: DataFrame, right: DataFrame, threshold: float = 0.0) -> DataFrame:
    """J05, of the sets of tokens."""
    scored = _with(dot_products(left, right), left, right, F.count("*")).withColumn("score", F.col("common") / (F.col("l_size") + F.col("r_size") - F.col("common")))
    return scored.where(F.col("score") >= threshold).select("l", "r", "score")


def containment(left: DataFrame, right: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Common tokens over the smaller set."""
    scored = _with(dot_products(left, right), left, right, F.count("*")).withColumn("score", F.col("common") / F.least("l_size", "r_size"))
    return scored.where(F.col("score") >= threshold).select("l", "r", "score")


def generalised_containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """The larger of dot over either side's squared norm."""
    square = F.sum(F.col("weight") * F.col("weight"))
    scored = _with(dot_products(left, right), left, right, square)
    return scored.select("l", "r", F.greatest(F.try_divide("dot", "l_size"), F.try_divide("dot", "r_size")).alias("score"))


def rescored(edges: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """Given edges (l, r) with the cosine of their vectors, from the threshold on; no other pairs are scored."""
    side = lambda x: vector.select(F.col("owner").alias(x), "token", F.col("weight").alias(f"{x}w"))
    square = lambda x: vector.groupBy(F.col("owner").alias(x)).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"{x}_size"))
    dots = edges.select("l", "r").join(side("l"), "l").join(side("r"), ["r", "token"]).groupBy("l", "r").agg(F.sum(F.col("lw") * F.col("rw")).alias("dot"))
    scored = dots.join(square("l"), "l").join(square("r"), "r").withColumn("score", F.try_divide("dot", F.col("l_size") * F.col("r_size")))
    return scored.where(F.col("score") >= threshold).select("l", "r", "score")


class TfIdf:
    """Token weights fixed by a corpus, for any strings afterwards. docs: owner, token."""

    def __init__(self, docs: DataFrame):
        self.idf = idf(vectors(docs))

    def vectors(self, tokens: DataFrame) -> DataFrame:
        """owner, token, weight of new strings; tokens that the corpus does not have weigh 0."""
        return tf_idf(vectors(tokens), self.idf)

    def similarities(self, left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
        """(l, r, score) by cosine, 0 without a common token. left, right: owner, token; pairs: l, r."""
        a, b = self.vectors(left), self.vectors(right)
        norm = lambda v, x: v.groupBy(F.col("owner").alias(x)).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"{x}_norm"))
        dots = pairs.join(a.select(F.col("owner").alias("l"), "token", F.col("weight").alias("w")), "l").join(b.select(F.col("owner").alias("r"), "token", F.col("weight").alias("v")), ["r", "token"])
        sums = dots.groupBy("l", "r").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        both = pairs.join(sums, ["l", "r"], "left").join(norm(a, "l"), "l", "left").join(norm(b, "r"), "r", "left")
        return both.select("l", "r", F.coalesce(F.try_divide("dot", F.col("l_norm") * F.col("r_norm")), F.lit(0.0)).alias("score"))


def block_sizes(vector: DataFrame) -> DataFrame:
    """(token, size)."""
    return vector.groupBy("token").agg(F.count("*").alias("size"))
