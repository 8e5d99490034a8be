"""What the near-duplicate join moves, and what the classifier's fit leaves to the driver."""

from wardstone.llm import ngram_join, quality


def test_rounds_between_classes_move_no_postings(spark, monkeypatch):
    seen, real = [], ngram_join._between_classes

    def watched(classed, *rest):
        plan = classed.groupBy("shingle", "class").count()._jdf.queryExecution().executedPlan().toString()
        seen.append("Exchange" in plan)
        return real(classed, *rest)

    monkeypatch.setattr(ngram_join, "_between_classes", watched)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]]), " ".join(words[:30]), "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert seen and not any(seen)


def test_the_fit_runs_in_a_task(spark, monkeypatch):
    def here(*args, **kwargs):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(quality.GatedAttention, "fit", here)
    docs = spark.createDataFrame([(i, "good words here " * 9 if i % 2 else "BAD!!! $$$ " * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    assert quality.fit_quality(docs, labels.where("quality = 1")) is None
