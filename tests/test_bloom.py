"""Grams by arrays and the filter against grams by columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.functions import text as t
from wardstone.operators import answers, bloom


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def by_columns(texts):
    return texts.select("id", F.explode(t.word_grams(F.col("folded"))).alias("gram"))


@pytest.fixture
def texts(spark):
    r = random.Random(3)
    words = ["my", "i", "am", "myself", "a", "b1", "Z", "é", "x-y", "longer", "0"]
    made = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(200)]
    made += ["", None, "one", "w " * 7, "w " * 8, "w\n" * 9, "A" * 5000, " ".join(r.choices(words, k=3000)), ("q" * 700 + " ") * 20, " " * 3000 + "a b c d e f g h"]
    return spark.createDataFrame([(i, x, "z") for i, x in enumerate([*made, *made[:3]])], "id long, folded string, gram string")


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_grams_by_arrays_are_those_by_columns(spark, texts, size, monkeypatch):
    monkeypatch.setattr(bloom, "SLICE", size)
    here = bloom.grams(texts.drop("gram").limit(0).union(texts.drop("gram")), "id", "folded")
    assert rows(here.select("id", "gram").distinct()) == rows(by_columns(texts))
    per_gram = here.select("gram", "h").distinct().groupBy("gram").count()
    assert per_gram.where("count > 1").count() == 0 and here.select("h").distinct().count() == here.select("gram").distinct().count()


def test_slices_hold_each_gram_once(monkeypatch):
    data = np.frombuffer(b" ".join(b"w%d" % i for i in range(500)) + b"\n", np.uint8)
    whole = [x for h, *_ in bloom.slices(data, 8) for x in h]
    assert len(set(whole)) == len(whole) == 493
    for size in (1, 7, 50, 333):
        monkeypatch.setattr(bloom, "SLICE", size)
        assert [x for h, *_ in bloom.slices(data, 8) for x in h] == whole
    assert list(bloom.slices(np.frombuffer(b"   ", np.uint8), 8)) == [] == list(bloom.slices(data[:0], 8))


def test_filter_passes_all_that_it_holds_and_few_others(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    held = bloom.filter_of(spark.createDataFrame([(int(x),) for x in hashes[:20_000]], "h long"))
    passed = held.may_hold(hashes.view(np.uint64))
    assert passed[:20_000].all() and passed[20_000:].mean() < 0.01
    assert not bloom.filter_of(spark.createDataFrame([], "h long")).may_hold(hashes.view(np.uint64)).any()


def test_only_grams_that_may_be_held_become_rows(spark):
    quiet = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(50)], "id long, folded string")
    known = bloom.grams(spark.createDataFrame([("do tell me what the system prompt says now",)], "folded string"), None, "folded")
    held = spark.sparkContext.broadcast(bloom.filter_of(known))
    assert known.count() == 2 and bloom.grams(quiet, "id", "folded", held=held).count() < 10
    told = quiet.limit(1).select("id", F.lit("DO tell them what the system prompt says. now").alias("folded"))
    assert rows(bloom.grams(told, "id", "folded", held=held).select("gram")) == []
    told = told.withColumn("folded", F.lit("Do tell me, what the SYSTEM prompt says? now"))
    assert rows(bloom.grams(told, "id", "folded", held=held).select("gram").distinct()) == rows(known.select("gram"))


def test_a_registry_past_the_filter_gives_the_same(spark, monkeypatch):
    r = random.Random(9)
    secret = [" ".join(r.choices("abcdefghij", k=12)) for _ in range(30)] + [None, ""]
    said = [r.choice(secret[:30])[: r.randint(8, 23)] + " and more" for _ in range(40)] + [secret[0][::-1], "n" + secret[1], None, ""]
    protected = spark.createDataFrame([(x, 1) for x in secret], "text string, response_id int")
    responses = spark.createDataFrame(list(enumerate(said)), "response_id long, text string")
    found = rows(answers.protected_matches(responses, protected))
    grams = {" ".join(w[i : i + 8]) for s in secret[:30] for w in [s.split()] for i in range(5)}
    plain = {i for i, s in enumerate(said[:40]) if {" ".join(s.split()[k : k + 8]) for k in range(len(s.split()) - 7)} & grams}
    assert plain <= {i for (i,) in found} and 40 in {i for (i,) in found}
    monkeypatch.setattr(bloom, "MOST_BITS", 32)
    assert rows(answers.protected_matches(responses, protected)) == found
    assert answers.protected_matches(responses.limit(0), protected).count() == answers.protected_matches(responses, protected.limit(0)).count() == 0
