"""Many questions against a table of vectors, tile by tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.operators import retrieval, tiles


def vectors(spark, n, seed, dim=8):
    values = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, embedding array<float>")
    return rows.repartition(3), values.astype(float)


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_fifty_thousand_questions_without_a_collect(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", most_bytes)
    monkeypatch.setattr(tiles, "TILE_BYTES", 300 * 64)
    n, k = (50_000, 3) if most_bytes else (5_000, 3)
    asked, q = vectors(spark, n, 1)
    table, c = vectors(spark, 700, 2)
    questions = asked.select(F.col("id").alias("question_id"), F.lit("ann").alias("username"), "embedding")
    tier = F.when(F.col("id") % 4 == 0, "restricted").otherwise("public")
    origin = F.when(F.col("id") % 3 == 0, "upload").otherwise("curated")
    chunks = table.select(F.col("id").cast("string").alias("chunk_id"), tier.alias("tier"), origin.alias("origin"), "embedding")
    grants = spark.createDataFrame([("ann", "public", 0), ("bob", "restricted", 2)], "username string, tier string, rank int")
    seen = []
    frame = type(asked)
    collect = frame.collect
    with monkeypatch.context() as m:
        m.setattr(frame, "collect", lambda self: seen.extend(collect(self)) or seen[-1:])
        found = retrieval.nearest_chunks(questions, chunks, grants, k)
    assert len(seen) == 1  # the row of counts; nothing else reaches the driver
    got = found.select("question_id", F.col("chunk_id").cast("long").alias("c"), "place", "budget").toPandas()
    distance = np.round(1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 12)
    ids = np.arange(700)
    names = ids.astype(str)
    for b in (0, 1):
        own = np.array(sorted(ids[(ids % 4 > 0) & ((ids % 3 == 0) == (b == 1))], key=lambda i: names[i]))
        best = own[np.argsort(distance[:, own], axis=1, kind="stable")[:, :k]]
        part = got[got.budget == b].sort_values(["question_id", "place"])
        assert (part.c.to_numpy().reshape(n, k) == best).all()


def test_ties_and_thresholds_over_tiles(spark, monkeypatch):
    """A hundred equal vectors: the least names by tier stay, whatever tile they lie in."""
    monkeypatch.setattr(tiles, "TILE_BYTES", 7 * 16)
    chunks = spark.createDataFrame([(f"{i:03}", "internal" if i % 2 else "public", None, [1.0, 0.0]) for i in range(100)], "chunk_id string, tier string, origin string, embedding array<float>").repartition(5)
    questions = spark.createDataFrame([(1, "ann", [2.0, 0.0]), (2, "ann", [0.0, 0.0]), (3, "zed", [1.0, 0.0]), (4, "ann", None)], "question_id long, username string, embedding array<float>")
    grants = spark.createDataFrame([("ann", "public", 0), ("ann", "internal", 1)], "username string, tier string, rank int")
    got = retrieval.nearest_chunks(questions, chunks, grants, 3).orderBy("question_id", "place").collect()
    assert [(r.question_id, r.chunk_id, r.distance) for r in got] == [(q, f"{i:03}", d) for q, d in ((1, 0.0), (2, 1.0)) for i in (0, 2, 4)]


def test_products_of_large_tiles_are_bounded():
    """A pair of full tiles needs a few blocks of distances, not all 16 million at once."""
    import tracemalloc

    import pyarrow as pa

    rng, nq, nc, size = np.random.default_rng(1), 2048, 8192, 8
    q, c = rng.normal(size=(nq, size)), rng.normal(size=(nc, size))
    q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, c))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    names = [f"n{i:05}" for i in range(nc)]
    batch = pa.RecordBatch.from_pydict({
        "size": pa.array([size], pa.int32()), "q_question_id": one(range(nq), pa.int64()), "q_ranks": one([1] * nq, pa.int32()), "q_m": pa.array([q.tobytes()], pa.binary()),
        "c_chunk_id": one(names, pa.string()), "c_tier": one(["public"] * nc, pa.string()), "c_rank": one([0] * nc, pa.int32()), "c_origin": one([None] * nc, pa.string()),
        "c_budget": one([0] * nc, pa.int32()), "c_m": pa.array([c.tobytes()], pa.binary()),
    })
    tracemalloc.start()
    found = list(retrieval._tile_search(4, True)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = pa.Table.from_batches(found).to_pandas()
    best = np.argsort(np.round(1 - q @ c.T, 12), axis=1, kind="stable")[:, :4]
    assert peak < 64 << 20
    assert got.groupby("question_id").chunk_id.apply(set).tolist() == [{names[i] for i in b} for b in best]
