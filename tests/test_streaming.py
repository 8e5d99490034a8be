import datetime as dt
import json
import os
import random

from wardstone.operators import audit, index
from wardstone.sources import corpus, versions
from wardstone.streaming import jobs


def finish(writer, checkpoint):
    query = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)


def landed(path, records):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(map(json.dumps, records)))


def test_sync_loop_survives_a_failure(spark, tmp_path):
    base = spark.createDataFrame([("public", "curated", "a.txt", "kept", "h")], "tier string, origin string, source string, text string, content_hash string")
    state = {"index": index.build_chunks(base), "fail": True}

    def store(new, number):
        if state["fail"]:
            state["fail"] = False
            raise RuntimeError("disk")
        rows = new.select("tier", "origin", "source", "text", "content_hash", "chunk_id", "chunk_index").collect()
        state["index"] = spark.createDataFrame(rows, new.select("tier", "origin", "source", "text", "content_hash", "chunk_id", "chunk_index").schema)

    for body in ("one", "two"):
        landed(tmp_path / "in", [{"id": "7", "title": "", "body": body, "acl": "public", "seq": 1}])
        jobs.start_sync(jobs.read_records(spark, str(tmp_path / "in")), lambda: state["index"], store, str(tmp_path / "cp"), every=None).awaitTermination(120)
    assert {(r.source, r.text) for r in state["index"].collect()} == {("a.txt", "kept"), ("tickets/7", "two")}


def test_snapshots_count_when_they_are_whole(spark, tmp_path):
    """Read back from the store, as a cached index would hide when counts are taken."""
    path, landing = str(tmp_path / "index"), tmp_path / "in"
    base = spark.createDataFrame([("public", "curated", "a.txt", "kept", "h")], "tier string, origin string, source string, text string, content_hash string")
    columns = ["tier", "origin", "source", "text", "content_hash", "chunk_id", "chunk_index"]
    index.build_chunks(base).select(*columns).write.parquet(f"{path}/start")
    state = {"path": f"{path}/start"}

    def store(new, number):
        new.select(*columns).write.parquet(f"{path}/{len(list((tmp_path / 'index').iterdir()))}")
        state["path"] = f"{path}/{len(list((tmp_path / 'index').iterdir())) - 1}"

    def record(id_, snapshot, records):
        return {"id": id_, "title": "", "body": f"body {id_}", "acl": "public", "seq": 1, "snapshot": snapshot, "records": records}

    def take():
        jobs.start_sync(
            jobs.read_records(spark, str(landing)), lambda: spark.read.parquet(state["path"]), store, str(tmp_path / "cp"), every=None,
            landed=lambda: spark.read.schema(jobs.RECORD_SCHEMA).json(str(landing)),
        ).awaitTermination(120)
        return {r.source for r in spark.read.parquet(state["path"]).collect()}

    landed(landing, [record("1", 1, 2), record("2", 1, 2)])
    assert take() == {"a.txt", "tickets/1", "tickets/2"}
    landed(landing, [record("1", 2, 2)])  # half of the second one
    assert take() == {"a.txt", "tickets/1", "tickets/2"}
    landed(landing, [record("3", 2, 2)])
    assert take() == {"a.txt", "tickets/1", "tickets/3"}
    landed(landing, [record("3", 3, 1), record("1", 4, 1)])  # two at once: the newer one counts
    assert take() == {"a.txt", "tickets/1"}


def audit_rows(n):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [
        {"ts": (start + dt.timedelta(seconds=20 * i)).isoformat(), "event": "auth.login", "actor": "ann" if i % 2 else "bob", "decision": "deny", "fields": {"i": str(i)}}
        for i in range(n)
    ]


def test_counts_alerts_and_search(spark, tmp_path):
    landed(tmp_path / "audit", audit_rows(60))
    stream = jobs.read_audit(spark, str(tmp_path / "audit"))
    for name, df in (("counts", jobs.tumbling_counts(stream, "decision", late="1 minute")), ("alerts", jobs.alerts(stream, least=2, late="1 minute")), ("found", jobs.search(stream, "bob"))):
        finish(df.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append"), tmp_path / f"cp-{name}")
    counts = spark.read.parquet(str(tmp_path / "counts")).collect()
    assert counts and all(r.n == 3 for r in counts)
    assert all(r.failed_logins == 2 for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    assert spark.read.parquet(str(tmp_path / "found")).count() == 30


def test_late_records_are_set_apart(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, at), (at, at + dt.timedelta(hours=1)), (None, at)], "at timestamp, received timestamp")
    fresh, late = jobs.late_records(df)
    assert (fresh.count(), late.count()) == (1, 2)


def test_snapshots_are_staged_over_restarts(spark, tmp_path):
    """Parts in several batches, a restart between them, an older snapshot after a newer one, a batch that comes again."""
    landing, stage, path = tmp_path / "in", str(tmp_path / "stage"), str(tmp_path / "index")
    base = spark.createDataFrame([("public", "curated", "a.txt", "kept", "h")], "tier string, origin string, source string, text string, content_hash string")
    index.write_index(index.build_chunks(base), path)

    def record(id_, snapshot, records, acl="public"):
        return {"id": id_, "title": "", "body": f"body {id_}", "acl": acl, "seq": 1, "snapshot": snapshot, "records": records}

    def take():
        jobs.start_snapshot_sync(jobs.read_records(spark, str(landing)), stage, path, str(tmp_path / "cp"), every=None, patience=4).awaitTermination(120)
        return {r.source for r in index.read_index(spark, path, corpus.tiers(spark)).collect()}, versions.current(spark, path)

    landed(landing, [record("1", 2, 2)])
    assert take()[0] == {"a.txt"}
    landed(landing, [record("2", 2, 2, "internal")])
    sources, version = take()
    assert sources == {"a.txt", "tickets/1", "tickets/2"} and version.notes["snapshot"] == "2"
    kept = version.batches["public", "curated"]
    landed(landing, [record("9", 1, 1)])  # older
    assert take()[0] == sources
    landed(landing, [record("1", 3, 3)])  # never whole
    assert take()[0] == sources and os.path.isdir(f"{stage}/records/snapshot=3") and not os.path.isdir(f"{stage}/records/snapshot=2")
    landed(landing, [record("3", 4, 1)])
    sources, version = take()
    assert sources == {"a.txt", "tickets/3"} and version.batches["public", "curated"] == kept and ("internal", "connector:tickets") not in version.batches
    again = spark.read.schema(jobs.RECORD_SCHEMA).json(str(landing)).where("snapshot = 4")
    jobs.stage_records(again, stage, 4)  # the last batch comes again after its version was published
    assert jobs.take_snapshot(spark, stage, path, 4) is None and versions.current(spark, path).number == version.number


def hits(n, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return sorted((start + dt.timedelta(seconds=rng.randrange(3600)), rng.choice("aabc")) for _ in range(n))


def test_limits_are_decided_in_event_order_and_state_ends(spark, tmp_path):
    schema = "key string, at timestamp"
    rows = hits(400)
    rng = random.Random(2)
    arrived = sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.randrange(500)))  # up to 500 s late
    parts = [arrived[i : i + 80] for i in range(0, 400, 80)]
    end = dt.datetime(2024, 1, 2)
    for part in [*parts, [(end, "z")], [(end + dt.timedelta(hours=1), "z")]]:
        spark.createDataFrame([(k, t) for t, k in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = jobs.limit_stream(stream, 5, 120).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.key, r.at, r.n, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).where("key <> 'z'").collect())
    batch = audit.rate_decisions(spark.createDataFrame([(k, t) for t, k in rows], schema), 5, 120)
    assert got == sorted((r.key, r.at, r.n, r.allowed) for r in batch.collect()) and len(got) == 400
    assert not all(r[3] for r in got)
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 4  # of z alone: a window, a waiting hit and their timers


def test_limits_order_a_key_over_arrow_batches(spark, tmp_path):
    schema = "key string, at timestamp"
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s)) for s in [*range(119, -1, -1)]] + [("z", start + dt.timedelta(hours=1))]  # newest first
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        finish(jobs.limit_stream(stream, 50, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), tmp_path / "cp")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()
    assert [r.n for r in got] == [*range(1, 61)] * 2 and [r.allowed for r in got] == ([True] * 50 + [False] * 10) * 2


def test_limits_hold_state_by_bucket_of_keys(spark, tmp_path):
    """300 keys, one of them null, wait in two buckets; decisions are those of a key alone, and hits without a time are dropped."""
    schema = "key string, at timestamp"
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{i}" if i else None, start + dt.timedelta(seconds=(7 * i + 40 * j) % 600)) for i in range(300) for j in range(6)]
    for part in ([*rows, ("k1", None)], [("z", start + dt.timedelta(minutes=15))], [("z", start + dt.timedelta(hours=1))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        decided = jobs.limit_stream(stream, 2, 100, buckets=2)
        query = decided.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 6  # a bucket's blobs and timers
    got = [(r.key, r.at, r.n, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).where("key <> 'z' or key is null").collect()]
    batch = audit.rate_decisions(spark.createDataFrame([(k or "none", t) for k, t in rows], schema), 2, 100).collect()
    expected = [(r.key, r.at, r.n, r.allowed) for r in batch]
    assert sorted((k or "none", *x) for k, *x in got) == sorted(expected) and len(got) == 1800
