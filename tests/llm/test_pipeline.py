"""The pipeline's stages against brute force over the smallest tables."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import components, duck, repeated_bytes
from wardstone.llm import decontamination, mixing
from wardstone.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns
        ids = {r.doc_id for r in before}
        left = {r.doc_id for r in after.collect()}
        if k == 0:
            bad = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
            good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
            assert len(left & bad) <= 1 and len(left & good) >= 0.97 * len(ids & good)
        elif k == 1:
            assert left == {c for _, _, c in components([(r.doc_id, r.text) for r in before])}
        elif k == 2:
            cut = dict(zip([r.doc_id for r in before], repeated_bytes([(r.doc_id, r.text) for r in before]), strict=True))
            assert left == ids and all(len((r.text or "").encode()) <= cut[r.doc_id][0] - cut[r.doc_id][1] for r in after.collect())
            assert all(r.text == b.text for r, b in zip(sorted(after.collect()), sorted(before), strict=True) if not cut[r.doc_id][1])
        elif k == 3:
            found = duck(decontamination.contamination_sql(), documents=docs, benchmark=table(spark, SF, "benchmark"))
            assert left == ids - {x[0] for x in found}
        else:
            assert Counter(map(tuple, after.select("doc_id", "size", "source_size", "target", "taken").collect())) == duck(mixing.mix_sql(), documents=docs)
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


LONG = " ".join(f"w{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, facts map<string,int>, `a.b` int, rid long, `row` string, row_id int"


def test_rows_are_judged_one_by_one(spark):
    """Null, empty, repeated and tied rows, maps, dotted and clashing names."""
    texts = [(3, LONG), (6, LONG), (6, LONG), (6, "other words entirely"), (None, LONG + " tail"), (7, None), (7, None), (8, ""), (None, "  "), (9, "short one"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, {"k": n}, n, 5, "x", 1) for n, (i, t) in enumerate(texts)], SCHEMA)
    stages = {name: f for name, f in corpus_pipeline.STAGES}
    sf = SF

    kept = stages["n-gram Jaccard join"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(3, LONG), (6, "other words entirely"), (7, None), (8, ""), (None, "  "), (9, "short one"), (None, None)]
    )

    cut = stages["suffix-array dedup"](spark, docs, sf)
    assert cut.columns == docs.columns
    got = cut.collect()
    want = [(i, n - gone, t if not gone else None) for (i, t), (n, gone, _, _) in zip(texts, repeated_bytes(texts), strict=True)]
    assert Counter((r.doc_id, len((r.text or "").encode())) for r in got) == Counter((i, n) for i, n, _ in want)
    assert Counter((r.doc_id, r.text) for r in got if r.text is None) == Counter((i, t) for i, t in texts if t is None)
    assert {t for i, _, t in want if t} <= {r.text for r in got} and all(set(r.facts) == {"k"} for r in got)

    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    mixed = [(1, item), (1, "clean words"), (None, item), (None, "more clean words"), (2, None), (2, None)]
    docs3 = spark.createDataFrame([(i, t, "en", "s", 1, {"k": n}, n, 5, "x", 1) for n, (i, t) in enumerate(mixed)], SCHEMA)
    clean = stages["benchmark decontamination"](spark, docs3, sf)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter([(1, "clean words"), (None, "more clean words"), (2, None), (2, None)])

    good = stages["quality classifier"](spark, docs, sf)  # no label fits these rows
    assert good.columns == docs.columns and good.count() == docs.count()
    assert stages["mixing sources to target weights"](spark, docs, sf).count() == docs.count()
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_stages_delete_only_their_own_tables(spark):
    from wardstone.llm.mixing import op10_mix_sources

    held = op10_mix_sources(spark, SF)
    n = held.count()
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[-2:]:
        stage(spark, docs, SF).count()
    assert held.count() == n


def test_one_long_labelled_text_shuts_out_no_others(spark, monkeypatch):
    from wardstone.llm import quality

    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 200)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    long = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.repeat("text", F.lit(40))).otherwise(F.col("text")))
    assert quality.fit_quality(long, table(spark, SF, "labels")) is not None
