"""Streams: periodic synchronisation, counts, alerts, live search and rate limits."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import AUDIT_SCHEMA
from ..operators.index import apply_sync, indexed_state, reconcile, sync_counts
from ..sources.corpus import RECORD_SCHEMA, TICKETS, last_record, map_records, tiers
from ..sources.versions import current, publish, read_version

log = logging.getLogger(__name__)


def read_records(spark: SparkSession, landing: str) -> DataFrame:
    """Source records as JSON files land."""
    return spark.readStream.schema(RECORD_SCHEMA).json(landing)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records as they are appended, with their own event time as `at`."""
    return spark.readStream.schema(AUDIT_SCHEMA).json(path).withColumn("at", F.try_to_timestamp("ts"))


def sync_actions(records: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted documents, actions) of one snapshot against the index."""
    wanted = last_record(map_records(records)).drop("seq")
    return wanted, reconcile(indexed_state(index.where(F.col("origin") == TICKETS)), wanted)


def synced(index: DataFrame, wanted: DataFrame, actions: DataFrame) -> DataFrame:
    """The index after a snapshot's actions; other origins' chunks stay as they are."""
    own = index.where(F.col("origin") == TICKETS)
    return index.where(~F.col("origin").eqNullSafe(F.lit(TICKETS))).unionByName(apply_sync(own, wanted, actions), allowMissingColumns=True)


def sync_batch(records: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new index, counts) of one snapshot against the index."""
    wanted, actions = sync_actions(records, index)
    return synced(index, wanted, actions), sync_counts(actions)


def whole_snapshot(batch: DataFrame, landed: DataFrame | None) -> tuple[int | None, DataFrame | None]:
    """(id, records) of the newest snapshot that a batch has records of; no records while some of it hasn't landed.

    Records name their snapshot and the number of records in it. All of that snapshot that has
    landed counts, in whatever files and batches it came. Records without an id are the batch's own snapshot.
    """
    newest = batch.agg(F.max("snapshot")).first()[0] if "snapshot" in batch.columns else None
    if newest is None:
        return None, batch
    own = (batch if landed is None else landed).where(F.col("snapshot") == newest)
    there, said = own.agg(F.count(F.lit(1)), F.max("records")).first()
    return newest, own if said is None or there >= said else None


def start_sync(
    records: DataFrame,
    load: Callable[[], DataFrame],
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = "60 seconds",
    landed: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Reconcile every whole snapshot that arrives. A batch that fails is logged and the loop goes on; the next snapshot repairs it.

    load reads the current index, store saves the new one for a batch number, landed reads all
    records so far; a snapshot older than the last one taken is passed over. Without `every` all
    that has landed is taken at once and the query ends.
    """
    taken: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        try:
            snapshot, rows = whole_snapshot(batch, landed() if landed else None)
            if rows is None or (snapshot is not None and taken and snapshot < taken[-1]):
                log.info("sync %s: snapshot %s is not whole or not the newest", number, snapshot)
                return
            old = load()
            wanted, actions = sync_actions(rows, old)
            actions.persist()  # reconciled once, for the counts and for the new index
            try:
                told = sync_counts(actions).first()
                store(synced(old, wanted, actions), number)
            finally:
                actions.unpersist()
            taken.extend([] if snapshot is None else [snapshot])
            log.info("sync %s: %s", number, told)
        except Exception:
            log.exception("sync %s failed", number)

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# ------------------------------------------------------------------ snapshots by staging


def stage_records(batch: DataFrame, stage: str, number: int) -> None:
    """Write a batch's records by snapshot, and its counts; a batch that comes again replaces what it wrote.

    stage/records/snapshot=<id>/batch=<number> holds records, stage/counts/batch=<number> a row a snapshot.
    """
    held = {f.name: f.dataType for f in StructType.fromDDL(RECORD_SCHEMA)}
    rows = batch.where(F.col("snapshot").isNotNull()).select(*[F.col(c).cast(t).alias(c) for c, t in held.items() if c in batch.columns]).persist()
    try:
        numbered = rows.withColumn("batch", F.lit(number))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot", "batch").parquet(f"{stage}/records")
        counts = rows.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.max("records").alias("announced"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{stage}/counts/batch={number}")
    finally:
        rows.unpersist()


def staged_counts(spark: SparkSession, stage: str) -> DataFrame:
    """snapshot, n, announced, last: how much of each snapshot is there, and the last batch that brought some."""
    rows = spark.read.schema("snapshot long, n long, announced long, batch long").option("basePath", f"{stage}/counts").parquet(f"{stage}/counts/batch=*")
    return rows.groupBy("snapshot").agg(F.sum("n").alias("n"), F.max("announced").alias("announced"), F.max("batch").alias("last"))


def take_snapshot(spark: SparkSession, stage: str, index_path: str, number: int, patience: int = 1000) -> dict[str, int] | None:
    """Reconcile the index with the newest whole snapshot that is newer than the one it has; counts of actions, or None if there is none.

    What has been taken is noted in the index's own version, so that neither a restart nor a batch that
    comes again takes an older snapshot, or one twice. Only partitions with changes are written.
    Staged records of taken snapshots, and of those that have brought nothing for `patience` batches, are deleted.
    """
    base = current(spark, index_path)
    taken = int(base.notes.get("snapshot", -1))
    counts = staged_counts(spark, stage).persist()
    try:
        ready = counts.where((F.col("snapshot") > taken) & (F.col("n") >= F.coalesce("announced", "n"))).agg(F.max("snapshot")).first()[0]
        done = None
        if ready is not None:
            records = spark.read.schema(RECORD_SCHEMA).option("basePath", f"{stage}/records").parquet(f"{stage}/records/snapshot={ready}")
            wanted = last_record(map_records(records)).drop("seq")
            own = spark.createDataFrame([], INDEXED)
            if base.schema is not None:
                own = read_version(spark, index_path, tiers(spark), base.number).where(F.col("origin") == TICKETS)
            actions = reconcile(indexed_state(own), wanted).persist()
            try:
                done = sync_counts(actions).first().asDict()
                touched = actions.where("action <> 'unchanged'").select("tier", F.lit(TICKETS).alias("origin")).distinct()
                publish(apply_sync(own, wanted, actions), index_path, touched, {"snapshot": str(ready), "batch": str(number)}, base)
            finally:
                actions.unpersist()
            taken = ready
        stale = counts.where((F.col("snapshot") <= taken) | (F.col("last") < number - patience)).select("snapshot").collect()  # a row a snapshot
        for r in stale:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{stage}/records/snapshot={r.snapshot}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return done
    finally:
        counts.unpersist()


#: Columns of an index before its first version.
INDEXED = "chunk_id string, tier string, origin string, source string, chunk_index int, text string, content_hash string"


def start_snapshot_sync(records: DataFrame, stage: str, index_path: str, checkpoint: str, every: str | None = "60 seconds", patience: int = 1000) -> StreamingQuery:
    """Stage what arrives and take every whole snapshot, newest first. Without `every` all that has landed is taken and the query ends.

    A batch that fails is tried again by the stream when it is restarted; it replaces what it had staged.
    """

    def one(batch: DataFrame, number: int) -> None:
        stage_records(batch, stage, number)
        log.info("batch %s: %s", number, take_snapshot(batch.sparkSession, stage, index_path, number, patience))

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def tumbling_counts(events: DataFrame, key: str, at: str = "at", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key under a watermark; records later than that go to late_records()."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), key, "n")
    )


def late_records(events: DataFrame, at: str = "at", received: str = "received", late: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """(in time, late) by how long a record took to arrive; late ones are appended to the table that per_minute() recounts exactly."""
    is_late = F.coalesce(F.col(at) < F.col(received) - F.expr(f"interval {late}"), F.lit(True))
    return events.where(~is_late), events.where(is_late)


def alerts(audit: DataFrame, least: int = 5, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows in which an actor has `least` refusals or failed logins, or at all uploads or refused writes."""
    event, denied = F.col("event"), F.col("decision") == "deny"
    counted = audit.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "actor").agg(
        F.count_if((event == "query.answered") & denied).alias("refusals"),
        F.count_if((event == "auth.login") & denied).alias("failed_logins"),
        F.count_if(event == "ingest.upload").alias("uploads"),
        F.count_if((event == "auth.role") & denied).alias("refused_writes"),
    )
    on = (F.col("refusals") >= least) | (F.col("failed_logins") >= least) | (F.col("uploads") > 0) | (F.col("refused_writes") > 0)
    return counted.where(on).select(F.col("w.start").alias("start"), "actor", "refusals", "failed_logins", "uploads", "refused_writes")


def search(stream: DataFrame, needle: str, columns: tuple[str, ...] = ("event", "actor", "decision", "mode", "tier")) -> DataFrame:
    """Rows whose text in any of the columns, or field values, contains the needle."""
    hay = F.concat_ws(" ", *columns, *([F.to_json("fields")] if "fields" in stream.columns else []))
    return stream.where(F.contains(hay, F.lit(needle)))


def packed(columns: dict[str, list], schema: pa.Schema) -> bytes:
    """Rows as one Arrow stream, the form in which a bucket's state holds them."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.table(columns, schema))
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> list[list]:
    """The columns of packed() rows."""
    return [c.to_pylist() for c in pa.ipc.open_stream(blob).read_all().columns]


class FixedWindow(StatefulProcessor):
    """Counts keys' hits in windows that open at a key's first hit; refused hits count too.

    What Spark groups by is a bucket of keys, so that calls and state are paid by the bucket, not by
    the key. Hits wait until the watermark has passed them and are then decided key by key in the
    order of their times. A key's window goes when it has ended, a bucket's state when no hit waits
    and no window is open.
    """

    WAITING = pa.schema([("key", pa.string()), ("micros", pa.int64())])
    OPEN = pa.schema([("key", pa.string()), ("start", pa.int64()), ("n", pa.int64())])

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.width = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = None
        for batch in rows:
            micros = batch["micros"].tolist()
            self.waiting.appendValue((packed({"key": batch["key"].tolist(), "micros": micros}, self.WAITING),))
            least = min(micros) if least is None else min(least, *micros)
        if least is not None:
            self.handle.registerTimer(-(-least // 1000))  # milliseconds, rounded up
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[str | None, list[int]] = {}
        rest: dict[str, list] = {"key": [], "micros": []}
        for (blob,) in self.waiting.get() if self.waiting.exists() else ():
            for name, micros in zip(*unpacked(blob), strict=True):
                if micros <= passed:
                    due.setdefault(name, []).append(micros)
                else:
                    rest["key"].append(name)
                    rest["micros"].append(micros)
        windows = {name: (start, n) for name, start, n in zip(*unpacked(self.open.get()[0]), strict=True)} if self.open.exists() else {}
        out = []
        for name, times in due.items():
            start, n = windows.get(name, (None, 0))
            for micros in sorted(times):
                if start is None or micros - start >= self.width:
                    start, n = micros, 0
                n += 1
                out.append((name, micros, n, n <= self.limit))
            windows[name] = (start, n)
        live = [(name, start, n) for name, (start, n) in windows.items() if -(-(start + self.width) // 1000) * 1000 > passed]
        if due:
            self.waiting.put([(packed(rest, self.WAITING),)]) if rest["key"] else self.waiting.clear()
        if live:
            self.open.update((packed(dict(zip(self.OPEN.names, map(list, zip(*live, strict=True)), strict=True)), self.OPEN),))
        else:
            self.open.clear()
        ahead = rest["micros"] + [start + self.width for _, start, _ in live]
        if ahead:
            self.handle.registerTimer(-(-min(ahead) // 1000))
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["key", "micros", "n", "allowed"])
        return frame if out else frame.astype({"micros": "int64", "n": "int64", "allowed": bool})

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, limit: int, window_seconds: int, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """requests (key, at) with n and allowed, decided in the order of their times once the watermark (`late` behind the newest) has passed them.

    Hits that come later than that are dropped; late_records() tells them apart before. Hits without a
    time are dropped too. Needs the RocksDB state store. State is held for keys with waiting hits or
    an open window only, in so many buckets of keys; a stream keeps its number of buckets. A bucket's
    waiting hits and open windows are decided together in memory, so very large streams want more buckets.
    """
    hits = requests.select("key", "at").where(F.col("at").isNotNull()).withWatermark("at", late)
    hits = hits.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "at", F.unix_micros("at").alias("micros"))
    decided = hits.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FixedWindow(limit, window_seconds), outputStructType="key string, micros long, n long, allowed boolean", outputMode="append", timeMode="EventTime"
    )
    return decided.select("key", F.timestamp_micros("micros").alias("at"), "n", "allowed")
