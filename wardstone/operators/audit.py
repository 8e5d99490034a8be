"""The audit stream as tables: records, totals, rates and rate-limit decisions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_VALUE, MAX_ITEMS = 200, 20
AUDIT_SCHEMA = "ts string, event string, actor string, decision string, mode string, tier string, fields map<string,string>"


def scrub_value(value: Column) -> Column:
    """A string over 200 characters is cut and says by how much."""
    over = F.length(value) - MAX_VALUE
    return F.when(over > 0, F.concat(F.substring(value, 1, MAX_VALUE), F.lit("...[+"), over.cast("string"), F.lit(" chars]"))).otherwise(value)


def scrub_list(values: Column) -> Column:
    return F.slice(F.transform(values, scrub_value), 1, MAX_ITEMS)


def write_audit(records: DataFrame, path: str) -> None:
    """Append records as JSON lines; map and list values are scrubbed."""
    out = records
    for name, kind in records.dtypes:
        if kind == "map<string,string>":
            out = out.withColumn(name, F.transform_values(name, lambda _, v: scrub_value(v)))
        elif kind == "array<string>":
            out = out.withColumn(name, scrub_list(F.col(name)))
        elif kind == "string" and name not in ("ts", "event", "actor", "decision"):
            out = out.withColumn(name, scrub_value(F.col(name)))
    out.write.mode("append").json(path)


def scan_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records with their own event time as `at`; records without a time are kept with null."""
    return spark.read.schema(AUDIT_SCHEMA).json(path).withColumn("at", F.try_to_timestamp("ts"))


def totals(audit: DataFrame) -> DataFrame:
    """One row: errors, answered, denied, failed_logins, uploads."""
    event, decision = F.col("event"), F.col("decision")
    return audit.agg(
        F.count_if(decision == "error").alias("errors"),
        F.count_if(event == "query.answered").alias("answered"),
        F.count_if(decision == "deny").alias("denied"),
        F.count_if((event == "auth.login") & (decision == "deny")).alias("failed_logins"),
        F.count_if(event == "ingest.upload").alias("uploads"),
    )


def answered_by_mode(audit: DataFrame) -> DataFrame:
    return audit.where("event = 'query.answered'").groupBy("mode").agg(F.count(F.lit(1)).alias("answered"))


#: Counts that add up over any split of an actor's records.
SIGNS = ("n", "refused", "redacted", "suppressed_answers", "unverified_answers")


def _signs() -> list[Column]:
    """SIGNS of answered queries, as aggregates."""
    number = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)).try_cast("long"), F.lit(0))
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("decision") == "deny").alias("refused"),
        F.count_if(F.coalesce(F.try_element_at("fields", F.lit("output_rules")), F.lit("[]")) != "[]").alias("redacted"),
        F.count_if(number("suppressed") > 0).alias("suppressed_answers"),
        F.count_if(number("unverified") > 0).alias("unverified_answers"),
    ]


def _answered(audit: DataFrame) -> DataFrame:
    return audit.where("event = 'query.answered'")


def _rated(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.select(
        *keys, "n", (F.col("refused") / F.col("n")).alias("refusal_rate"), (F.col("redacted") / F.col("n")).alias("redaction_rate"),
        "suppressed_answers", "unverified_answers",
    )


def actor_rates(audit: DataFrame) -> DataFrame:
    """Per actor over answered queries: n, refusal_rate, redaction_rate, and counts with suppressed or unverified chunks."""
    return _rated(_answered(audit).groupBy("actor").agg(*_signs()), "actor")


def sliding_rates(audit: DataFrame, panes: int, pane_seconds: int, at: str = "at") -> DataFrame:
    """start, actor and actor_rates() of windows of `panes` panes that start with every pane; windows without records have no row.

    Records are counted by pane once, before anything is multiplied; a window sums the panes that it
    shares with its neighbours. Records without a time are in no window.
    """
    pane = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (pane_seconds * 1_000_000))
    counted = _answered(audit).where(F.col(at).isNotNull()).groupBy("actor", pane.alias("pane")).agg(*_signs())
    spread = counted.withColumn("first", F.explode(F.sequence(F.col("pane") - (panes - 1), F.col("pane"))))
    windows = spread.groupBy("actor", "first").agg(*[F.sum(c).alias(c) for c in SIGNS])
    return _rated(windows.withColumn("start", F.timestamp_seconds(F.col("first") * pane_seconds)), "start", "actor")


def actor_sessions(audit: DataFrame, gap: str = "30 minutes", at: str = "at") -> DataFrame:
    """start, end, actor and actor_rates() of each run of an actor's answered queries with less than a gap between them.

    end is the last record's time and the gap. On a stream with a watermark sessions come out once they are closed.
    """
    timed = _answered(audit).where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    sessions = timed.groupBy(F.session_window(at, gap).alias("w"), "actor").agg(*_signs())
    return _rated(sessions.withColumns({"start": F.col("w.start"), "end": F.col("w.end")}), "start", "end", "actor")


def uploads_listing(audit: DataFrame) -> DataFrame:
    """Uploads, newest first."""
    get = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return audit.where("event = 'ingest.upload'").select("at", "actor", "tier", *map(get, ("source", "chunks", "bytes", "replaced"))).orderBy(
        F.desc("at"), "actor"
    )


def per_minute(audit: DataFrame, key: str, at: str = "at", width: str = "1 minute") -> DataFrame:
    """Tumbling counts by key; exact over all records, late ones included."""
    return audit.groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def rate_decisions(requests: DataFrame, limit: int, window_seconds: int, partitions: int | None = None) -> DataFrame:
    """requests (key, at, ...) with n and allowed, by fixed windows that open at a key's first hit.

    A window ends when a hit is window_seconds or more after its start; refused hits count too.
    Hits at one time are taken in any order, as they differ only by their number. Each key's
    hits stream in order through constant state, so a hot key costs time and no memory.
    """
    spark = requests.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [f for f in requests.schema.fields if f.name not in ("n", "allowed")]
    plain = requests.select(*[f.name for f in columns]).withColumn("_micros", F.unix_micros(F.col("at").cast("timestamp")))
    schema = plain.drop("_micros").schema.add("n", "long").add("allowed", "boolean")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start, count = object(), 0, 0
        width = window_seconds * 1_000_000
        for batch in batches:
            keys = batch.column("key")
            at = pc.fill_null(batch.column("_micros"), 0).to_numpy()
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(at)] if len(at) else []
            numbers = np.zeros(len(at), np.int64)
            for lo, hi in itertools.pairwise(edges):
                if (key := keys[lo].as_py()) != current:
                    current, start, count = key, int(at[lo]), 0
                while lo < hi:  # a window at a time
                    end = lo + int(np.searchsorted(at[lo:hi], start + width))
                    numbers[lo:end] = np.arange(count + 1, count + 1 + end - lo)
                    count += end - lo
                    if end < hi:
                        start, count = int(at[end]), 0
                    lo = end
            kept = batch.drop_columns(["_micros"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers), pa.array(numbers <= limit)], [*kept.schema.names, "n", "allowed"])

    return plain.repartition(n_parts, "key").sortWithinPartitions("key", "_micros").mapInArrow(decide, schema)
