"""op3: secrets in every version of every path, through an incremental ledger of blobs.

A blob is a text, addressed by the SHA-256 of its UTF-8. The ledger is a folder of Parquet files, one folder for each version of the
rules, with a row for each blob that was scanned under it, found or not. A scan addresses all versions it is given, takes one of each
blob that the ledger does not have under the current rules, scans only those, adds them to the ledger, and joins the findings back to
every path and version with that blob. Scanning again scans nothing; new rules scan all blobs once more.

Kinds, in this order: assign, access, hex (the base), then private (a PEM private key's header and its body), jwt (three base64url parts).
Spans are code points, end exclusive. A null or empty text has no findings, a very long one is scanned whole, an empty table gives no rows.
Equal texts are one blob and each get all findings. A path may occur many times, with its versions; ids may be null, or repeated. A blob
that two scans added at a time, or one that was begun again, is in the ledger twice with the same findings, and counts once. Columns other
than the three named are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import common

RULES_VERSION = 1
#: Kinds in order, patterns, and the least length that counts (assign: of group 2).
KINDS = ("assign", "access", "hex", "private", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so that a minimum of 16 drops just the shorter ones
PRIVATE = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
MARK = "[redacted]"
LEAST = {"assign": 12, "access": 18}
#: One of these is in any text that has an assign match.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
FOUND = "array<struct<kind: string, start: int, end: int>>"
FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [("private", *m.span()) for m in PRIVATE.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, found for each blob and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, FOUND_ARROW)], ["blob", "found"])

    return common.map_arrow(blobs.select("blob", "text"), run, f"blob string, found {FOUND}")


class Ledger:
    """Findings by blob and version of the rules, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, rules_version: int = RULES_VERSION):
        self.spark, self.path = spark, f"{folder}/rules={rules_version}"

    def findings(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            # an empty list would be copied by Python workers of its own, which each executor then keeps
            return self.spark.range(0).select(F.lit(None).cast("string").alias("blob"), F.lit(None).cast(FOUND).alias("found"))
        return self.spark.read.schema(f"blob string, found {FOUND}").parquet(self.path)

    def scan(self, versions: DataFrame, path_col: str = "path", version_col: str | None = "version", text_col: str = "text") -> DataFrame:
        """path, version, blob, found for every row of versions."""
        version = versions[f"`{version_col}`"] if version_col else F.lit(0)
        named = versions.select(versions[f"`{path_col}`"].alias("path"), version.alias("version"), F.coalesce(versions[f"`{text_col}`"], F.lit("")).alias("text"))
        addressed = named.withColumn("blob", F.sha2("text", 256))
        work = common.work_dir(self.spark)
        rows = common.stored(addressed.select("path", "version", "blob"), f"{work}/rows")
        # of the rows with a blob that the ledger does not have, one lends its text
        lenders = rows.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("row"))
        unseen = lenders.join(self.findings().select("blob"), "blob", "left_anti")
        lent = unseen.select(F.col("row.path").alias("p"), F.col("row.version").alias("v"), F.col("blob").alias("b"))
        one = F.col("path").eqNullSafe(F.col("p")) & F.col("version").eqNullSafe(F.col("v")) & (F.col("blob") == F.col("b"))
        blobs = addressed.join(lent.hint("shuffle_hash"), one, "left_semi")
        # a row that is there twice lends its text twice
        scan_blobs(blobs).dropDuplicates(["blob"]).write.mode("append").parquet(self.path)
        found = self.findings().where(F.size("found") > 0).dropDuplicates(["blob"])
        none = F.expr(f"cast(array() as {FOUND})")
        return rows.join(found, "blob", "left").select("path", "version", "blob", F.coalesce("found", none).alias("found"))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with a mark in place of each run of overlapping spans; spans in order of their starts."""
    out, done = [], 0
    for start, end in spans:
        if start >= done:
            out += [text[done:start], MARK]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with MARK in place of secrets in the text; count_col, if there is one, counts the new text's characters.
    Rows meet findings by their blob, whatever their ids."""
    found = ledger.scan(docs, id_col, None, text_col).where(F.size("found") > 0)
    free = lambda name: name if name not in docs.columns else free(name + "_")
    blob, spans, short = free("found_blob"), free("found_spans"), free("found_short")
    found = common.stored(found.dropDuplicates(["blob"]).select(F.col("blob").alias(blob), F.col("found").alias(spans)), f"{common.work_dir(docs.sparkSession)}/found")
    addressed = docs.withColumn(blob, F.sha2(F.coalesce(docs[f"`{text_col}`"], F.lit("")), 256)).withColumn(short, F.xxhash64(blob))
    # a short hash of the blob finds the rows to look at; what it takes too many does no harm
    ids = found.select(F.xxhash64(blob).alias(short)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hit = common.matching(addressed, ids, short, True).join(found, blob, "left").select(*columns, spans)
    clean = common.matching(addressed, ids, short, False).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not f else redact(t, [(s["start"], s["end"]) for s in f]) for t, f in zip(batch.column(text_col).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            for name, values in ((text_col, texts), (count_col, [None if t is None else len(t) for t in texts])):
                if name in batch.schema.names:
                    field = batch.schema.field(name)
                    batch = batch.set_column(batch.schema.get_field_index(name), field, pa.array(values, field.type))
            yield batch.drop_columns([spans])

    return common.map_arrow(hit, run, docs.schema).unionByName(clean)


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, f"{common.work_dir(spark)}/ledger")
    found = ledger.scan(common.table(spark, sf_dir, "documents"), "doc_id", None)
    count = lambda kind: F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    base = "filter(found, s -> s.kind in ('assign', 'access', 'hex'))"
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))
