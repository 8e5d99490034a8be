"""The chunk index: building chunks, reconciling with sources, review, sealing and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_key, chunks, content_hash
from ..sources.corpus import CURATED, TIERS, tiers
from ..sources.versions import Version, current, publish, read_version

ENC = "aes-gcm-1"
#: Stands for the hash of rows that aren't sealed under the current scheme, so that they are written anew.
UNSEALED = "unsealed"


def build_chunks(documents: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """A row for each chunk: the document's columns but text, chunk_id, chunk_index, text."""
    rest = [c for c in documents.columns if c != "text"]
    return documents.select(*rest, F.explode(chunks(F.col("text"), size, overlap)).alias("_c")).select(
        chunk_key(F.col("source"), F.col("_c.chunk_index")).alias("chunk_id"), *rest, F.col("_c.chunk_index"), F.col("_c.text")
    )


def replace_sources(index: DataFrame, new: DataFrame, keep_reviews: bool = False) -> DataFrame:
    """The index with every source of `new` replaced whole, so that a shorter version loses its tail.

    keep_reviews: an approval stays while the source's content_hash is what was approved.
    """
    touched = new.select("tier", "source").distinct()
    if keep_reviews:
        by = F.col("reviewed_by") if "reviewed_by" in index.columns else F.lit(None).cast("string")
        approved = index.where(F.col("reviewed").eqNullSafe(F.lit(True))).groupBy("tier", "source", "content_hash").agg(F.max(by).alias("_by"), F.lit(True).alias("_approved"))
        plain = new.drop("reviewed", "reviewed_by")
        new = plain.join(approved, ["tier", "source", "content_hash"], "left").withColumns({"reviewed": F.coalesce("_approved", F.lit(False)), "reviewed_by": F.col("_by")}).drop("_by", "_approved")
    return index.join(touched, ["tier", "source"], "left_anti").unionByName(new, allowMissingColumns=True)


def indexed_state(index: DataFrame, sealed: bool = False) -> DataFrame:
    """tier, origin, source, content_hash; a source with any row not sealed under the current scheme gets UNSEALED when sealing is on."""
    state = F.max("content_hash")
    if sealed:
        state = F.when(F.bool_or(~F.col("enc").eqNullSafe(F.lit(ENC))), UNSEALED).otherwise(state)
    return index.groupBy("tier", F.coalesce("origin", F.lit(CURATED)).alias("origin"), "source").agg(state.alias("content_hash"))


def reconcile(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """tier, source, action: added, updated, deleted or unchanged. A move between tiers is a deletion and an addition."""
    had = state.select("tier", "source", F.col("content_hash").alias("had"), F.lit(True).alias("is_had"))
    want = wanted.select("tier", "source", F.col("content_hash").alias("want"), F.lit(True).alias("is_wanted"))
    return had.join(want, ["tier", "source"], "full_outer").select(
        "tier", "source",
        F.when(F.col("is_wanted").isNull(), "deleted").when(F.col("is_had").isNull(), "added")
        .when(F.col("had").eqNullSafe(F.col("want")), "unchanged").otherwise("updated").alias("action"),
    )


def sync_counts(actions: DataFrame) -> DataFrame:
    """One row of counts."""
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "updated", "deleted", "unchanged")])


def apply_sync(index: DataFrame, wanted: DataFrame, actions: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """The index after a reconciliation; only added and updated documents are chunked."""
    gone = actions.where("action in ('deleted', 'updated')").select("tier", "source")
    fresh = wanted.join(actions.where("action in ('added', 'updated')").select("tier", "source"), ["tier", "source"], "left_semi")
    return index.join(gone, ["tier", "source"], "left_anti").unionByName(build_chunks(fresh, size, overlap), allowMissingColumns=True)


def retract(index: DataFrame, seen: DataFrame, tier: str, origin: str) -> DataFrame:
    """Sources of this tier and origin that the sweep has not seen."""
    own = index.where((F.col("tier") == tier) & (F.coalesce("origin", F.lit(CURATED)) == origin))
    return own.select("tier", "source").distinct().join(seen.select("source").distinct(), "source", "left_anti")


def apply_reviews(index: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index with approved sources reviewed, reviews of unknown sources). reviews: reviewer, tier, source."""
    approved = reviews.groupBy("tier", "source").agg(F.max("reviewer").alias("_reviewer"))
    keep = [c for c in index.columns if c not in ("reviewed", "reviewed_by")]
    old_by = F.col("reviewed_by") if "reviewed_by" in index.columns else F.lit(None).cast("string")
    done = index.join(approved, ["tier", "source"], "left").select(
        *keep,
        F.when(F.col("_reviewer").isNotNull(), F.lit(True)).otherwise(F.col("reviewed")).alias("reviewed"),
        F.coalesce("_reviewer", old_by).alias("reviewed_by"),
    )
    return done, reviews.join(index.select("tier", "source").distinct(), ["tier", "source"], "left_anti")


def corpus_statistics(index: DataFrame) -> DataFrame:
    """Chunks of each tier, zero included."""
    counts = index.groupBy("tier").count()
    return tiers(index.sparkSession).join(F.broadcast(counts.where(F.col("tier").isin(*TIERS))), "tier", "left").select(
        "tier", F.coalesce("count", F.lit(0)).alias("chunks")
    )


def stale_chunks(index: DataFrame, documents: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunks that their current source text no longer holds."""
    current = build_chunks(documents.select("tier", "source", "text"), size, overlap).select(
        "tier", "chunk_id", content_hash(F.col("text")).alias("_hash")
    )
    return index.withColumn("_hash", content_hash(F.col("text"))).join(current, ["tier", "chunk_id", "_hash"], "left_anti").drop("_hash")


def write_index(index: DataFrame, path: str, touched: DataFrame | None = None, notes: dict[str, str] | None = None, base: Version | None = None) -> Version:
    """Publish an index, partitioned by tier and origin, as one new version; with `touched` (tier, origin) only these partitions are written.

    Readers see the old version or the new one. What is retracted is in no later version; expire() deletes its files.
    """
    return publish(index, path, touched, notes, base)


def read_index(spark: SparkSession, path: str, grants: DataFrame, number: int | None = None) -> DataFrame:
    """Chunks in the granted tiers of the newest version. grants: tier; there is no reader without grants."""
    return read_version(spark, path, grants, number)


def replace_in_index(spark: SparkSession, path: str, new: DataFrame, keep_reviews: bool = False) -> Version:
    """Publish an index with every source of `new` (chunks) replaced whole. Only partitions that hold or get rows of these sources are read and written."""
    base = current(spark, path)
    whole = read_index(spark, path, tiers(spark), base.number)
    sources = new.select("tier", "source").distinct()
    touched = whole.join(sources, ["tier", "source"], "left_semi").select("tier", "origin").unionByName(new.select("tier", "origin")).distinct()
    marks = F.broadcast(touched)  # a row a partition
    own = whole.join(marks, [F.equal_null(whole[c], touched[c]) for c in ("tier", "origin")], "left_semi")
    return write_index(replace_sources(own, new, keep_reviews), path, touched, base=base)


def seal(index: DataFrame, key: Column) -> DataFrame:
    """Encrypt text and the values of extra with a fresh nonce each, bound to the chunk's id; the `enc` marker tells sealed rows."""

    def closed(value: Column) -> Column:
        return F.base64(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("chunk_id")))

    out = index.withColumn("text", closed(F.col("text")))
    if "extra" in index.columns:
        out = out.withColumn("extra", F.transform_values("extra", lambda _, v: closed(v)))
    return out.withColumn("enc", F.lit(ENC))


def unseal(index: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(readable rows, rows that fail). Only the marker decides whether a row is decrypted; one that fails goes, the others stay."""

    def opened(value: Column) -> Column:
        return F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), key, F.lit("GCM"), F.lit("DEFAULT"), F.col("chunk_id")).cast("string")

    is_sealed = F.col("enc").eqNullSafe(F.lit(ENC))
    out = index.withColumn("_text", F.when(is_sealed, opened(F.col("text"))).otherwise(F.col("text")))
    bad = is_sealed & F.col("_text").isNull()
    if "extra" in index.columns:
        out = out.withColumn("_extra", F.when(is_sealed, F.transform_values("extra", lambda _, v: opened(v))).otherwise(F.col("extra")))
        bad = bad | (is_sealed & F.exists(F.map_values(F.coalesce("_extra", F.create_map().cast("map<string,string>"))), lambda v: v.isNull()))
        good = out.where(~bad).drop("text", "extra").withColumnsRenamed({"_text": "text", "_extra": "extra"})
        return good, out.where(bad).drop("_text", "_extra")
    return out.where(~bad).drop("text").withColumnRenamed("_text", "text"), out.where(bad).drop("_text")
