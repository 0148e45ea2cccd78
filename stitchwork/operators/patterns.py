"""Templates of values: what a column's values have in common, and what differs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions import text

#: Words that say nothing about a template.
STOP_WORDS = tuple("a an and as at be but by for i if in into is it no of on or such that the their then there these they this to was will with you".split())


def common_substring(values: list[str]) -> str:
    """The longest string that all values hold, the first of equals."""
    shortest = min(values, key=len)
    for n in range(len(shortest), 0, -1):
        for i in range(len(shortest) - n + 1):
            if all(shortest[i : i + n] in v for v in values):
                return shortest[i : i + n]
    return ""


def template(values: list[str], least: int = 3) -> str:
    """A pattern with a group for what differs, around common strings of at least so many characters, left and right alike."""
    values = list(dict.fromkeys(values))
    if len(values) == 1:
        return re.escape(values[0])
    common = common_substring(values)
    if len(common.strip()) < least:
        return "(.*)"
    left, right = zip(*(v.split(common, 1) for v in values), strict=True)
    side = lambda parts: template(list(parts), least) if any(parts) else ""
    return side(left) + re.escape(common) + side(right)


def mined(cells: DataFrame, least_support: float = 0.05, least_tokens: float = 4) -> DataFrame:
    """(col_id, pattern, support, n): by column, clusters of values around the most frequent token left, from the support on, whose
    values are long enough on average. A cluster's template is made of all its distinct values, which meet in one task for it."""
    distinct = cells.where("v is not null").groupBy("col_id", "v").agg(F.count("*").alias("n"))
    tokens = F.array_distinct(text.tokens(F.col("v"), STOP_WORDS))
    long = distinct.withColumn("words", F.size(text.tokens(F.col("v")))).withColumn("token", F.explode(tokens))
    df = long.groupBy("col_id", "token").agg(F.sum("n").alias("support"))
    # each value belongs to its most frequent token: what a greedy choice by falling frequency gives it to
    best = long.join(df, ["col_id", "token"]).groupBy("col_id", "v", "n", "words").agg(F.max(F.struct("support", "token")).alias("best"))
    total = distinct.groupBy("col_id").agg(F.sum("n").alias("total"))
    sizes = best.groupBy("col_id", "best.token").agg(F.sum("n").alias("support"), F.avg("words").alias("words")).join(total, "col_id")
    large = sizes.where((F.col("support") >= least_support * F.col("total")) & (F.col("words") >= least_tokens)).select("col_id", "token")
    members = best.select("col_id", F.col("best.token").alias("token"), "v", "n").join(large, ["col_id", "token"], "left_semi")
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["col_id"].iloc[0], pdf["token"].iloc[0], template(sorted(pdf["v"])))], columns=["col_id", "token", "pattern"])

    made = members.select("col_id", "token", "v").groupBy("col_id", "token").applyInPandas(run, "col_id string, token string, pattern string").where("pattern != '(.*)'")
    met = members.join(made, ["col_id", "token"]).where(F.expr("v rlike concat('(?s)^', pattern, '$')"))
    return met.groupBy("col_id", "pattern").agg(F.sum("n").alias("support"), F.count("*").alias("n_values"))


def applied(value: Column, patterns: list[str]) -> Column:
    """The groups of the first pattern that a value fits, null if it fits none."""
    found = [F.when(value.rlike(f"^{p}$"), F.array(*(F.regexp_extract(value, f"^{p}$", i + 1) for i in range(re.compile(p).groups)))) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("array<string>")
