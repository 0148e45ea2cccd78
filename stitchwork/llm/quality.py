"""op8: quality rules, in DataFrame functions only.

Base rules count words, characters, symbols, repeated lines and words in repeated windows of three words, and fail a document of under
50 words or of which more than half the words stand in repeated windows.

The verdict on the rest is by hashed n-grams: each whole word, and each pair of neighbouring words, goes to one of a fixed number of
buckets. Two multinomials over the buckets are fitted, one on the trusted documents (labelled quality 1), one on the whole raw corpus. A
bucket's ratio is that of its count in the trusted documents to the count expected there by the raw multinomial, both increased by PSEUDO,
so that buckets too rare to tell anything have a ratio near 1, whatever the sizes of the two. A document's score is the sum of its
n-grams' log-likelihood ratios over their number. Ratios are rounded to whole millionths, so that sums are exact in whatever order they
are made, and exactly the documents with a score of at least the threshold are kept. The corpus is read twice: once to count, and once
for rules and scores, each row by itself; the ratios, one number for each bucket, go along as one array.

A null text has no words, fails the base rules and is not kept; so does an empty one. Very long texts are read whole. Equal texts get
equal rows, and rows with the same doc_id, null included, are scored each by itself. An empty table gives no rows. Without trusted
documents all ratios are 0 and the base rules alone decide. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import common

#: What separates words, and what counts as a symbol.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
BUCKETS = 1 << 16
#: Occurrences added to each bucket's count and expected count.
PSEUDO = 5
THRESHOLD = -0.15
#: Trusted documents that the target is fitted on; of more labelled ones, a fixed sample of about so many.
TRUSTED_MOST = 200_000
SCALE = 1_000_000


def with_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words, hashed (the words' 64-bit hashes), row (all columns)."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    named = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), row)
    # plain replacements and a split at one character are far cheaper than a pattern
    blanks = reduce(lambda c, space: F.replace(c, F.lit(space), F.lit(" ")), SPACES[1:], F.col("text"))
    worded = named.withColumn("words", F.array_remove(F.split(blanks, " "), ""))
    return worded.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id and the base rules' columns for each row, and more columns made from words and hashed. Windows are told apart by a 64-bit
    hash of their words' 64-bit hashes."""
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    counted = with_words(docs, id_col, text_col).withColumns({"n_words": F.size("words"), "lines": F.filter(F.split("text", "\n"), has_word)})
    windows = F.when(F.col("n_words") >= 3, F.expr("transform(sequence(1, n_words - 2), i -> xxhash64(hashed[i - 1], hashed[i], hashed[i + 1]))"))
    # only where hashes repeat, windows are sorted: equal ones are then neighbours
    in_order = F.sort_array(F.expr("transform(windows, (h, i) -> struct(h as h, i as i))"))
    again = F.expr("transform(filter(transform(in_order, (x, k) -> struct(x.i as i, x.h = get(in_order, k - 1).h or x.h = get(in_order, k + 1).h as twice)), x -> x.twice), x -> x.i)")
    covered = F.size(F.array_union("again", F.array_union(F.transform("again", lambda i: i + 1), F.transform("again", lambda i: i + 2))))
    found = counted.withColumn("windows", windows).withColumn("in_order", F.when(F.size("windows") > F.size(F.array_distinct("windows")), in_order)).withColumn("again", again)
    plain = reduce(lambda c, symbol: F.replace(c, F.lit(symbol), F.lit("")), SYMBOLS, F.col("text"))
    columns = found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(plain)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"), *more,
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return columns.withColumn("base_failed", failed)


def buckets() -> Column:
    """The bucket of each word and of each pair of neighbours."""
    one = F.expr(f"transform(hashed, h -> cast(pmod(h, {BUCKETS}) as int))")
    two = F.expr(f"transform(slice(hashed, 2, greatest(size(hashed) - 1, 0)), (h, i) -> cast(pmod(xxhash64(hashed[i], h), {BUCKETS}) as int))")
    return F.concat(one, two)


def bounded(trusted: DataFrame, most: int = TRUSTED_MOST) -> DataFrame:
    """Distinct ids, as many as about `most` if there are more: the same ones whenever the table is the same."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("trusted_id")).where("trusted_id is not null").distinct()
    n = ids.count()
    return ids if n <= most else ids.where(F.pmod(F.xxhash64("trusted_id"), F.lit(n)) < most)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, ratios: a number of whole millionths for each bucket, in their order. trusted: a table whose first column has trusted ids."""
    spark = docs.sparkSession
    marked = with_words(docs, id_col, text_col).join(F.broadcast(bounded(trusted)), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = marked.select(F.when(F.col("trusted_id").isNotNull(), 1).otherwise(0).alias("is_trusted"), F.explode(buckets()).alias("bucket"))
    counts = common.stored(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("is_trusted").alias("target")), f"{common.work_dir(spark)}/buckets")
    all_ = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    expected = F.col("raw") * F.lit(all_.target / max(1, all_.raw))
    ratio = F.round(F.log((F.col("target") + PSEUDO) / (expected + PSEUDO)) * SCALE).cast("long")
    each = spark.range(BUCKETS).join(counts.select("bucket", ratio.alias("ratio")), F.col("id") == F.col("bucket"), "left")
    in_order = F.sort_array(F.collect_list(F.struct("id", F.coalesce("ratio", F.lit(0)).alias("ratio"))))
    return common.stored(each.agg(in_order.getField("ratio").alias("ratios")), f"{common.work_dir(spark)}/ratios")


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base rules' columns, base_failed, score, kept, row (all columns of docs) for each row."""
    ratios = log_ratios(docs, trusted, id_col, text_col)
    grams = (2 * F.size("words") - 1).cast("long").alias("n_grams")
    both = base_rules(docs, id_col, text_col, buckets().alias("buckets"), grams, F.col("row")).withColumn("ratios", ratios.scalar())
    summed = both.withColumn("total", F.expr("aggregate(buckets, 0L, (sum, b) -> sum + ratios[b])")).drop("buckets", "ratios")
    passes = F.col("total") >= F.lit(round(threshold * SCALE)) * F.col("n_grams")
    scored = summed.withColumn("score", F.when(F.col("n_grams") > 0, F.col("total") / SCALE / F.col("n_grams")))
    whole = scored.withColumn("kept", ~F.col("base_failed") & passes).drop("total", "n_grams")
    # a filter on the result would be pushed down and make nested expressions over and over again; none goes below a generator
    return whole.select(F.inline(F.array(F.struct(*whole.columns))))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir)).drop("row")
