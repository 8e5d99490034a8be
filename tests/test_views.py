"""Views of a text in Python against the same as columns; how work on texts is spread."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from wardstone.functions import text as t, views
from wardstone.operators import answers


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(4)
    bits = ["a", "Z", "charlie", "Alpha", "seven", "7", " ", "\n", "\u0085", " ", "-", ".", "é", "é", "İ", "K", "ﬁ", "Ａ", "а", "Ρ", "​", "‮", "й", "漢", "한", "😀", "�", "=", "+/", "\x00", "ß"]
    made = ["".join(r.choices(bits, k=r.randint(0, 60))) for _ in range(300)]
    hidden = [base64.b64encode(x.encode()).decode() for x in made[:60]]
    made += [" ".join(h[i : i + n] for i in range(0, len(h), n)) for h in hidden for n in (3, 1000)]
    made += ["".join(r.choices("ABCxyz019+/=", k=r.randint(20, 70))) for _ in range(200)]
    return spark.createDataFrame([(i, x) for i, x in enumerate(made)], "id long, text string"), made


def test_views_are_those_of_columns(odd):
    """Folded texts compare by what words and cores are made of."""
    df, made = odd
    folded = df.select("id", "text", t.normalise(F.col("text")).alias("f"), F.explode(t.decoded_variants(F.col("text"))).alias("v"))
    cut = folded.select("id", F.lower("f").alias("f"), t.phonetic_fold(F.col("f")).alias("p"), F.lower(t.normalise(F.col("v"))).alias("v"))
    plain = lambda c: F.regexp_replace(c, "[^a-z0-9]", " ")
    want = cut.groupBy("id").agg(F.max(plain("f")), F.max(F.replace("p", F.lit(" "), F.lit(""))), F.array_sort(F.collect_list(plain("v")))).collect()
    bare = lambda b: "".join(c if c.isalnum() else " " for c in b.decode("ascii"))
    for i, f, p, v in want:
        squeeze = lambda x: x.split()
        assert squeeze(bare(views.folded(made[i]))) == squeeze(f) and views.spelled(views.folded(made[i])).decode() == p
        assert sorted(map(squeeze, map(bare, views.decoded(made[i])))) == sorted(map(squeeze, v))
        assert [c.decode() for c in views.cores(made[i])][0] == f.replace(" ", "")
    assert len(want) == len(made)


def test_costly_work_on_texts_is_spread(spark, odd):
    """One input partition, as a file of one row group gives, becomes many before texts are searched."""
    one = odd[0].coalesce(1).withColumnRenamed("id", "response_id")
    for found in (answers.secret_leaks(one, spark.createDataFrame([("charliealpha",)], "core string")), answers.protected_matches(one, odd[0])):
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "RepartitionByExpression" in plan
    assert answers.dealt(one, "response_id", "text").rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
