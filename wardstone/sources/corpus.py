"""Corpus intake: files, source records and uploads become one document table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, nfkc, strip

log = logging.getLogger(__name__)

# Tiers in order, roles, origins, accepted suffixes and limits; below, the texts of violations.
TIERS = ("public", "internal", "restricted")
ROLES = ("reader", "uploader", "approver")
CURATED, UPLOAD, TICKETS = "curated", "upload", "connector:tickets"
SUFFIXES = (".txt", ".md")
MAX_BYTES = 2 * 1024 * 1024
QUERY_CHARS, USERNAME_CHARS, FILENAME_CHARS = (3, 2000), 64, 128
RECORD_SCHEMA = "id string, title string, body string, author string, acl string, updated_at string, seq int, snapshot long, records long"
DOCUMENT_COLUMNS = ("tier", "source", "origin", "text", "title", "author", "updated_at", "content_hash", "reviewed", "uploaded_by")


def tiers(spark: SparkSession) -> DataFrame:
    """The tier dimension: tier, rank."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "tier string, rank int")


def scan_files(spark: SparkSession, base: str, origin: str = CURATED) -> DataFrame:
    """Files below <base>/<tier>/: tier, source, length, content. Contents over the size limit aren't read, and null.

    Names and lengths come first; the contents of a second listing are joined to them, under a
    filter of the length that the file source takes before it opens a file.
    """
    root = base.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    contents = listed.where(F.col("length") <= MAX_BYTES).select("path", "content")
    files = listed.select("path", "length").join(contents, "path", "left")
    relative = F.regexp_extract("path", r"^.*?\Q" + root.split(":", 1)[-1].lstrip("/") + r"\E/(.*)$", 1)
    return (
        files.select("path", "length", "content")
        .withColumn("relative", relative)
        .withColumn("tier", F.regexp_extract("relative", "^([^/]+)/", 1))
        .where(F.col("tier").isin(*TIERS) & ~F.col("relative").rlike(r"(^|/)\.gitkeep$"))
        .select("tier", F.concat(F.lit("" if origin == CURATED else f"{origin}/"), "relative").alias("source"),
                F.lit(origin).alias("origin"), "length", "content")
    )


def intake_gate(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): suffix, then size, then UTF-8; the first failure is the reason."""
    suffix = F.lower(F.regexp_extract("source", r"(\.[^./]*)$", 1))
    checked = files.withColumn(
        "reason",
        F.when(~suffix.isin(*SUFFIXES), "suffix")
        .when(F.col("length") > MAX_BYTES, "too_large")
        .when(~F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False)), "not_utf8"),
    )
    accepted = checked.where("reason is null").select("tier", "source", "origin", F.col("content").cast("string").alias("text"))
    return accepted, checked.where("reason is not null").select("tier", "source", "origin", "length", "reason")


def map_records(records: DataFrame) -> DataFrame:
    """Source records as documents; rows of unknown acl, without id or with a blank body are dropped."""
    title, body = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("body", F.lit("")))
    text = F.when(title != "", F.concat(title, F.lit("\n\n"), body)).otherwise(body)
    return records.where(F.col("acl").isin(*TIERS) & F.col("id").isNotNull() & (body != "")).select(
        F.col("acl").alias("tier"), F.concat(F.lit("tickets/"), F.col("id").cast("string")).alias("source"), F.lit(TICKETS).alias("origin"),
        text.alias("text"), title.alias("title"), F.coalesce("author", F.lit("unknown")).alias("author"),
        F.coalesce(F.col("updated_at").cast("string"), F.lit("")).alias("updated_at"), content_hash(text).alias("content_hash"),
        F.lit(False).alias("reviewed"), *(["seq"] if "seq" in records.columns else []),
    )


def last_record(documents: DataFrame, order: str = "seq") -> DataFrame:
    """Of documents that share tier and source the one with the greatest order value."""
    latest = Window.partitionBy("tier", "source").orderBy(F.desc(order))
    return documents.withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place")


# ------------------------------------------------------------------ validation


def _printable(value: Column) -> Column:
    return strip(F.regexp_replace(nfkc(value), r"[\p{Cc}\p{Cf}]", ""))


def validate_query(df: DataFrame, col: str = "query") -> DataFrame:
    """Adds the normalised query and `violation`: the rule that it breaks, never its value."""
    clean = _printable(F.col(col))
    low, high = QUERY_CHARS
    return df.withColumn(col, clean).withColumn(
        "violation",
        F.when(F.col(col).isNull(), "query must be a string")
        .when(F.length(col) < low, f"query must be at least {low} characters")
        .when(F.length(col) > high, f"query must be at most {high} characters"),
    )


def username_violation(name: Column) -> Column:
    text = strip(name)
    return (
        F.when(name.isNull(), "username must be a string")
        .when((text == "") | (F.length(text) > USERNAME_CHARS), f"username must be 1-{USERNAME_CHARS} characters")
        .when(~text.rlike(r"^[\p{L}\p{N}._-]+$"), "username may contain only letters, digits, '.', '_' and '-'")
    )


def filename_violation(name: Column) -> Column:
    text = _printable(name)
    return (
        F.when(name.isNull(), "filename must be a string")
        .when((text == "") | (F.length(text) > FILENAME_CHARS), f"filename must be 1-{FILENAME_CHARS} characters")
        .when(text.contains("/") | text.isin(".", ".."), "filename may not contain a path")
        .when(~text.rlike(r"^[\p{L}\p{N}._\- ]+$"), "filename may contain only letters, digits, '.', '_', '-' and spaces")
        .when(~F.lower(F.regexp_extract(text, r"^.+(\.[^.]+)$", 1)).isin(*SUFFIXES), "filename must end in one of: .md, .txt")
    )


def tier_violation(tier: Column, allowed: Column) -> Column:
    return F.when(~F.coalesce(F.array_contains(allowed, tier), F.lit(False)), "unknown tier")


def split_valid(df: DataFrame, violation: str = "violation") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(violation).isNull()).drop(violation), df.where(F.col(violation).isNotNull())


def take_uploads(uploads: DataFrame, grants: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected). uploads: upload_id, username, filename, tier, content; grants: username, tier; indexed: tier, source."""
    allowed = grants.groupBy("username").agg(F.collect_set("tier").alias("allowed"))
    checked = uploads.join(allowed, "username", "left").withColumn(
        "violation",
        F.coalesce(
            tier_violation(F.col("tier"), F.col("allowed")),
            filename_violation(F.col("filename")),
            F.when(F.coalesce(strip(F.col("content")), F.lit("")) == "", "document is empty"),
            F.when(F.octet_length("content") > MAX_BYTES, f"document must be at most {MAX_BYTES} bytes"),
        ),
    )
    good, bad = split_valid(checked)
    source = F.concat_ws("/", F.lit(UPLOAD), "tier", _printable(F.col("filename")))
    known = indexed.select("tier", "source").distinct().withColumn("replaced", F.lit(True))
    documents = good.withColumn("source", source).join(known, ["tier", "source"], "left").select(
        "upload_id", "tier", "source", F.lit(UPLOAD).alias("origin"), F.col("content").alias("text"),
        content_hash(F.col("content")).alias("content_hash"), F.lit(False).alias("reviewed"), F.col("username").alias("uploaded_by"),
        F.coalesce("replaced", F.lit(False)).alias("replaced"),
    )
    return documents, bad.select("upload_id", "username", "tier", "violation")


def union_sources(*documents: DataFrame) -> DataFrame:
    """Documents of several sources in one table; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), documents)


def sweep_sources(spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]], path: str) -> tuple[DataFrame | None, DataFrame]:
    """(documents of all sources that could be read, failures: name, error). A source that fails takes no other along.

    Each source is written on its own below path, so a failure shows where it happens and not when the union is used.
    """
    read, failed = [], []
    for name, load in loaders.items():
        try:
            documents = load()
            documents.write.mode("overwrite").parquet(f"{path}/{name}")
            read.append(spark.read.schema(documents.schema).parquet(f"{path}/{name}"))
        except Exception as error:
            log.warning("source %s failed: %s", name, type(error).__name__)
            failed.append((name, type(error).__name__))
    return union_sources(*read) if read else None, spark.createDataFrame(failed, "name string, error string")


def manifest_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, sha256, status for each pinned artifact: match, mismatch or missing. files: name, content."""
    actual = files.select("name", F.sha2("content", 256).alias("actual"))
    return manifest.join(actual, "name", "left").select(
        "name", "sha256", "actual",
        F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "match").otherwise("mismatch").alias("status"),
    )


def manifest_decision(audit: DataFrame) -> DataFrame:
    """One row: deny on any mismatch, allow when all match, else not_yet_present."""
    return audit.agg(
        F.when(F.count_if(F.col("status") == "mismatch") > 0, "deny")
        .when(F.count_if(F.col("status") == "missing") > 0, "not_yet_present")
        .otherwise("allow")
        .alias("decision")
    )
