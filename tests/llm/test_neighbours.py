"""What the permutation index moves, and its shards and rounds against plain versions."""

import time

import numpy as np
import pyarrow as pa

from wardstone.llm import neighbours


def frame(spark, v, ids=None):
    ids = np.arange(len(v)) if ids is None else ids
    return spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))}))


def shuffled(spark):
    """Bytes that all tasks so far have written for shuffles."""
    time.sleep(1.5)
    spark.range(1).collect()
    return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_what_queries_find_is_not_moved(spark):
    v = np.random.default_rng(5).normal(size=(20_000, 64))
    df = frame(spark, v)
    before = shuffled(spark)
    assert len(neighbours.nearest(df).collect()) == 400 * 5
    assert 0 < shuffled(spark) - before < 4 * v.size * 4  # bytes of floats


def test_shards_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 90)
    monkeypatch.setattr(neighbours, "ASKED", 2)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(20, 7))[rng.integers(0, 20, 401)].astype(np.float32)  # copies: ties, and with 20 pivots every file is read
    ids = rng.permutation(1000)[:401] * 2
    got = neighbours.nearest(frame(spark, v, ids)).collect()
    x = v.astype(np.float64)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0).tolist():
        score = (x * x[i]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[i] * x[i]).sum()))
        order = [j for j in np.lexsort((ids, -score.round(12))) if j != i][:5]
        want |= {(int(ids[i]), r, int(ids[j]), round(score[j], 9)) for r, j in enumerate(order, 1)}
    assert len(got) == len(want) > 4 * 5 * 2
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == want


def test_smaller_weights_rank_as_the_footrule_distance(monkeypatch):
    monkeypatch.setattr(neighbours, "FILE", 8)
    rng = np.random.default_rng(7)
    for n_pivots, compared, probed, n in ((30, 9, 3, 21), (300, 128, 24, 50), (1, 1, 1, 3), (5, 5, 5, 7)):
        near = np.array([rng.permutation(n_pivots)[:compared] for _ in range(n + 4)])
        shard = neighbours.Shard(np.arange(n), rng.normal(size=(n, 4)), near[:n], n_pivots, probed)
        for own, common in zip(near[n:], shard.common(near[n:]), strict=True):
            for theirs, sum_ in zip(near[:n], common.tolist(), strict=True):
                places = [np.full(n_pivots, compared), np.full(n_pivots, compared)]
                places[0][own], places[1][theirs] = np.arange(compared), np.arange(compared)
                met = set(own[:probed].tolist()) & set(theirs[:probed].tolist())
                assert sum_ == (compared * (compared + 1) - np.abs(places[0] - places[1]).sum()) // 2 if met else sum_ == 0
