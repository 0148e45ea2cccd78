"""Similarities of two values, as column expressions from 0 to 1; null if a side is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of tokens."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def token_containment(a: Column, b: Column) -> Column:
    """The larger share of one side's distinct tokens that the other has."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def deviation(a: Column, b: Column) -> Column:
    """Smaller over larger magnitude; 1 for equal numbers, 0 for different signs."""
    return F.when(a == b, 1.0).when(a * b <= 0, 0.0).otherwise(F.least(F.abs(a), F.abs(b)) / F.greatest(F.abs(a), F.abs(b)))


def date_similarity(a: Column, b: Column, day: float = 1, month: float = 3, year: float = 5, years: int = 10) -> Column:
    """Weighted agreement of day, month and year, a year falling off to 0 over so many years."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.year(a) - F.year(b)) / years)
    same = lambda f: (f(a) == f(b)).cast("double")
    return (day * same(F.dayofmonth) + month * same(F.month) + year * near) / (day + month + year)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the Levenshtein distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def combined(parts: list[tuple[Column, float]], threshold: float) -> Column:
    """The weighted mean, null below the threshold."""
    total = sum(w for _, w in parts)
    score = sum((F.coalesce(c, F.lit(0.0)) * (w / total) for c, w in parts), F.lit(0.0))
    return F.when(score >= threshold, score)


def over_lists(a: Column, b: Column, similarity, strict: bool = False) -> Column:
    """The best similarity of any two elements of two arrays; the worst if strict."""
    all_ = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: similarity(x, y))))
    return F.array_min(all_) if strict else F.array_max(all_)
