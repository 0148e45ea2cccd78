"""Cleaning of cell values, as column expressions. Null stays null everywhere; a value that becomes blank becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names, decimal numbers with an optional exponent and percent sign, hexadecimal numbers.
FILENAME = r"[\w,-]+\.(html|htm|asp|php)$"
ANY_FILENAME = r"^[\w,-]+\.\w+$"
NUMBER = r"(?i)[+-]?(0x[0-9a-f]+(\.[0-9a-f]*)?(p[+-]?\d+)?|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)%?"
BRACKET, ALL_BRACKETS = r"^.*\(([^)]*)\).*$", r"\([^)]*\)"
NUMBERED = r"^(\d*)\. (.+)$"


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def bracket_text(c: Column) -> Column:
    """What stands in the last pair of brackets, null without any."""
    return F.when(c.rlike(BRACKET), F.regexp_extract(c, BRACKET, 1))


def without_brackets(c: Column) -> Column:
    """All bracketed parts removed."""
    return blank_to_null(F.regexp_replace(c, ALL_BRACKETS, ""))


def leading_number(c: Column) -> Column:
    """The number of '12. name', as a double."""
    return F.when(c.rlike(NUMBERED), F.regexp_extract(c, NUMBERED, 1).try_cast("double"))


def without_leading_number(c: Column) -> Column:
    """B08, B09."""
    return F.when(c.rlike(NUMBERED), F.regexp_extract(c, NUMBERED, 2)).otherwise(c)


def normalised(c: Column) -> Column:
    """Lower case, sentence marks to spaces, only a-z, 0-9 and single spaces."""
    marks = F.regexp_replace(F.lower(c), r"[.!?]+", " ")
    return blank_to_null(F.regexp_replace(F.regexp_replace(marks, r"[^a-z0-9\s]", ""), r"\s+", " "))


def normalised_cell(c: Column) -> Column:
    """As B11, for cells of web tables: brackets of both kinds and a leading number go first."""
    bare = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", "")
    return normalised(without_leading_number(F.trim(bare)))


def tokens(c: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case words of letters a-z and digits."""
    found = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda t: t != "")
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else found


def without_filename(c: Column) -> Column:
    """B13."""
    return blank_to_null(F.regexp_replace(c, FILENAME, ""))


def without_numbers(c: Column) -> Column:
    """B14."""
    return blank_to_null(F.regexp_replace(c, NUMBER, ""))


def at_least(c: Column, n: int) -> Column:
    """Null if shorter."""
    return F.when(F.length(c) >= n, c)


def looks_like_filename(c: Column) -> Column:
    """B24, for one value."""
    return c.rlike(ANY_FILENAME)


def without_time(c: Column) -> Column:
    """B16, the part that patterns can express: dates, clock times, months, weekdays, years and durations go."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(c, TIME, ""), r"\s+", " "))


#: Names of months and weekdays, and forms of dates, times and durations.
TIME = r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|\d{1,2}:\d{2}(:\d{2})?( ?[ap]m)?|\d{1,2} ?[ap]m|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?( \d{1,2},?)?( \d{4})?|(mon|tues|wednes|thurs|fri|satur|sun)day|(19|20)\d{2}(-(19|20)?\d{2})?|\d+ (second|minute|hour|day|week|month|year)s?)\b"
