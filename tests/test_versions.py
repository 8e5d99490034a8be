"""Published versions of an index."""

import os

import pytest
from pyspark.sql import functions as F

from wardstone.operators import index
from wardstone.sources import corpus, versions

SCHEMA = "chunk_id string, tier string, origin string, source string, text string"


def frame(spark, *rows):
    return spark.createDataFrame([(f"{t}{o}{s}", t, o, s, x) for t, o, s, x in rows], SCHEMA)


def texts(spark, path, *names, number=None):
    grants = corpus.tiers(spark).where(F.col("tier").isin(*(names or corpus.TIERS)))
    return sorted((r.tier, r.origin or "", r.source, r.text) for r in index.read_index(spark, path, grants, number).collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


OLD = [("public", "curated", "a", "1"), ("public", "upload", "b", "1"), ("internal", "a/b=c", "c", "1"), ("restricted", None, "d", "1")]


def test_readers_see_the_old_version_or_the_new_one(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        texts(spark, path)
    index.write_index(frame(spark, *OLD), path)
    old = sorted((t, o or "", s, x) for t, o, s, x in OLD)
    assert texts(spark, path) == old and texts(spark, path, "public") == old[1:3] if old[0][0] == "internal" else True
    held = index.read_index(spark, path, corpus.tiers(spark))
    before = files(path)
    index.replace_in_index(spark, path, frame(spark, ("public", "upload", "b", "2"), ("internal", "upload", "e", "2")))
    assert texts(spark, path) == sorted([*[r for r in old if r[2] != "b"], ("public", "upload", "b", "2"), ("internal", "upload", "e", "2")])
    assert sorted((r.tier, r.origin or "", r.source, r.text) for r in held.collect()) == old  # a pinned reader
    assert texts(spark, path, number=1) == old
    assert len(files(path) - before) == 2 and before <= files(path)  # the others weren't written again
    assert versions.expire(spark, path, 1) == 0 and len(versions._numbers(spark, path)) == 1  # the first batch still holds partitions


def test_partitions_that_lose_all_rows_are_gone(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(frame(spark, *OLD), path)
    gone = frame(spark, ("public", "upload", "b", "1")).select("tier", "origin")
    index.write_index(frame(spark).limit(0), path, gone)
    assert [r[2] for r in texts(spark, path)] == ["c", "a", "d"]
    index.write_index(frame(spark, ("public", "curated", "a", "3")), path)
    assert texts(spark, path) == [("public", "curated", "a", "3")] and versions.expire(spark, path, 1) == 2
    index.write_index(frame(spark).limit(0), path)
    assert texts(spark, path) == []


def test_a_failure_before_the_last_step_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    base = index.write_index(frame(spark, *OLD), path)
    monkeypatch.setattr(versions, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.replace_in_index(spark, path, frame(spark, ("public", "upload", "b", "2")))
    monkeypatch.undo()
    assert len(texts(spark, path)) == 4 and ("public", "upload", "b", "1") in texts(spark, path)
    index.replace_in_index(spark, path, frame(spark, ("public", "upload", "b", "3")))
    with pytest.raises(versions.VersionConflictError):
        index.write_index(frame(spark, *OLD), path, base=base)
    assert ("public", "upload", "b", "3") in texts(spark, path)
