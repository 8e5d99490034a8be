"""Operators against brute force, over the smallest tables and over awkward rows."""

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from wardstone.llm import chat, decontamination, licenses, mixing, neighbours, ngram_join, quality, repeats, token_counts
from wardstone.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rid long, score double"
LONG = " ".join(f"w{i}" for i in range(60))
AWKWARD = [
    (0, None, None, None, None, 1, 1, 0.5), (1, "", "en", "b", 0, 1, 1, 0.5), (2, " \n\t ", "en", "b", 3, 1, 1, 0.5), (3, "one two", "en", "a", 7, 1, 1, 0.5),
    (4, "one two", "en", "a", 7, 1, 1, 0.5), (5, LONG, "en", "a", 200, 1, 1, 0.5), (6, LONG + " tail", "en", "c", 205, 1, 1, 0.5), (6, LONG + " tail", "en", "c", 205, 1, 1, 0.5),
    (None, "head " + LONG, "en", "é", 205, 1, 1, 0.5), (8, "x" * 300, "en", "a", 300, 1, 1, 0.5), (9, "a " * 500, "en", "漢", 1000, 1, 1, 0.5),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def repeated_words(texts, n=35):
    counts = Counter(tuple(w[i : i + n]) for w in map(words, texts) for i in range(len(w) - n + 1))
    for text in texts:
        w = words(text)
        gone = {j for i in range(len(w) - n + 1) if counts[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept).hexdigest()


def repeated_bytes(rows, n=50):
    rank = [(2**63 - 1 if d is None else d) for d, _ in rows]
    least = {}
    for r, (_, text) in zip(rank, rows, strict=True):
        b = (text or "").encode()
        for i in range(len(b) - n + 1):
            least[b[i : i + n]] = min(r, least.get(b[i : i + n], r))
    for r, (_, text) in zip(rank, rows, strict=True):
        b = (text or "").encode()
        gone = {j for i in range(len(b) - n + 1) if least[b[i : i + n]] < r for j in range(i, i + n)}
        spans = sum(1 for j in gone if j - 1 not in gone)
        yield len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()


def test_repeated_words(spark, awkward, empty):
    for docs in (awkward, table(spark, SF, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = Counter((i, *x) for (i, _), x in zip(rows, repeated_words([t for _, t in rows]), strict=True))
        got = repeats.remove_repeated_words(docs)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert repeats.remove_repeated_words(empty).count() == 0


def test_repeated_bytes(spark, awkward, empty):
    for docs in (awkward, table(spark, SF, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = Counter((i, *x) for (i, _), x in zip(rows, repeated_bytes(rows), strict=True))
        got = repeats.remove_repeated_bytes(docs, with_text=True).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
        assert all(r.row.doc_id == r.doc_id and (r.n_removed or r.kept_text is not None) for r in got)
    assert repeats.remove_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("by_words", [True, False])
def test_minimisers_of_many_runs_are_split(spark, awkward, monkeypatch, by_words):
    monkeypatch.setattr(repeats, "HOT", 8)
    monkeypatch.setattr(repeats, "HEAVY", 20)
    passage = " ".join(f"p{i}" for i in range(45))
    held = [(100 + i, f"a{i} b{i} c{i} {passage} d{i % 90} e{i % 30} f{i}") for i in range(120)]
    rows = [(r[0], r[1]) for r in AWKWARD] + held
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    search = repeats.search_words if by_words else repeats.search_bytes

    def bounded(bodies, *rest):
        assert len(bodies) <= 60, "one minimiser's runs in one task"
        return search(bodies, *rest)

    got = repeats._removed(docs, repeats.WORDS if by_words else repeats.BYTES, bounded).collect()
    if by_words:
        want = Counter((i, *x) for (i, _), x in zip(rows, repeated_words([t for _, t in rows]), strict=True))
        assert Counter((r.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in got) == want
    else:
        want = Counter((i, *x) for (i, _), x in zip(rows, repeated_bytes(rows), strict=True))
        assert Counter((r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_long_words_that_a_power_sum_confuses(spark):
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    around = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*around[:20], w, *around[20:]])) for i, w in enumerate((x, y))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *f) for (i, _), f in zip(rows, repeated_words([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeated_words(docs).collect()) == want
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr("wardstone.llm.windows.LONG_ROW", 1 << 16)
    rng = np.random.default_rng(1)
    one = " ".join(f"v{i}" for i in rng.integers(0, 50_000, 40_000).tolist())
    rows = [(1, one), (2, "head " + one[100_000:190_000] + " tail"), (3, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeated_bytes(docs).collect()}
    want = {i: f for (i, _), f in zip(rows, repeated_bytes(rows), strict=True)}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    got = repeats.remove_repeated_words(docs).collect()
    want = Counter((i, *f) for (i, _), f in zip(rows, repeated_words([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        c = len(sets[i] & sets[j])
        if c and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_near_duplicates(spark, awkward, empty):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    drift = []
    for i in range(60):  # copies of copies: chains of links, many sets that no pivot links
        base = list(base)
        for j in rng.integers(0, 80, 1 + i % 3):
            base[j] = f"c{i}_{j}"
        drift.append((100 + i, " ".join(base)))
    extra = spark.createDataFrame(drift, "doc_id long, text string")
    for docs in (awkward.select("doc_id", "text", "score"), extra, table(spark, SF, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = ngram_join.near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_held_sets_of_different_slices_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MINORS", 3)
    rng = np.random.default_rng(11)
    keys = rng.permutation(np.arange(-40, 40) * 7919).tolist()
    group = [(5, k, 50, 0, 1 if i < 12 else 100 + i // 2) for i, k in enumerate(keys)]  # class 1 is the largest
    rest = spark.createDataFrame(group, "shingle long, key long, n int, place int, class long")
    loads = spark.createDataFrame([(5, 1, 68)], "shingle long, major long, minors long")
    counts = np.zeros(ngram_join.PARTS, np.uint32)
    counts[0] = 50
    signature = [0] * ngram_join.BITMAP + counts.view(np.int64).tolist()
    signatures = spark.createDataFrame([(k, signature) for k in keys], "key long, signature array<long>")
    class_of = {k: c for _, k, _, _, c in group}
    want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if class_of[a] != class_of[b]}
    got = [(r.a, r.b) for r in ngram_join._across_classes(rest, loads, signatures).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def duck(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(f"{name}_", df.toArrow())
        c.sql(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    return Counter(c.sql(sql).fetchall())


def test_mix(spark, awkward, empty):
    for docs in (awkward, table(spark, SF, "documents")):
        got = mixing.mix_sources(docs)
        assert Counter(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken").collect())) == duck(mixing.mix_sql(), documents=docs)
        assert all(r.taken <= 3 * r["size"] for r in got.collect())
    assert mixing.mix_sources(empty).count() == 0


def test_contamination(spark, awkward, empty):
    items = spark.createDataFrame([(1, LONG), (2, None), (3, "too short"), (4, " ".join(f"w{i}" if i % 6 else "z" for i in range(10, 40))), (4, "")], "item_id long, text string")
    for docs, bench in ((awkward, items), (table(spark, SF, "documents"), table(spark, SF, "benchmark"))):
        got = decontamination.contamination(docs, bench).select("doc_id", "item_id", "item_words", "matched", "window_matched")
        assert Counter(map(tuple, got.collect())) == duck(decontamination.contamination_sql(), documents=docs, benchmark=bench)
    found = {(r.doc_id, r.item_id) for r in decontamination.contamination(awkward, items).collect()}
    assert {(5, 1), (6, 1), (None, 1), (5, 4)} <= found and not {3, 2} & {i for _, i in found}
    assert decontamination.contamination(empty, items).count() == 0 and decontamination.contamination(awkward, items.limit(0)).count() == 0


def test_short_items_and_substitutions(spark):
    rng = np.random.default_rng(8)
    texts = {n: [f"i{n}w{j}" for j in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 10, 11, 15, 20, 300)}
    items = spark.createDataFrame([(n, " ".join(w), "x", 1) for n, w in texts.items()], "item_id long, text string, seed string, n long")
    rows, want = [], set()
    for n, words_ in texts.items():
        differ = n // 5 if n > 4 else 0
        for extra in (0, 1):
            for _ in range(4):
                changed = list(words_)
                for j in rng.choice(n, differ + extra, replace=False).tolist() if n < 100 else range(0, n, 4 - extra):
                    changed[j] = f"other{j}"
                doc = len(rows)
                rows.append((doc, " ".join(["before", *changed, "After\u00e9"]).upper(), 7, 7))
                if n < 100 and not extra:
                    want.add((doc, n))
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long, shift long")
    got = decontamination.contamination(docs, items)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert want <= found and not {x for x in found if x not in want and x[1] < 100}
    assert Counter(map(tuple, got.collect())) == duck(decontamination.contamination_sql(), documents=docs, benchmark=items)


def recall(vectors, **options):
    rows = vectors.orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in neighbours.nearest(vectors, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits, queries = 0, ids[ids % 50 == 0]
    for q in queries.tolist():
        own = v[ids == q][0]
        score = (v * own).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((own * own).sum()))
        order = [i for i in np.lexsort((ids, -score))[:6] if ids[i] != q][:5]
        hits += len({x for x, _ in got[q].values()} & set(ids[order].tolist()))
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(s - score[ids == x][0]) < 1e-12 for x, s in got[q].values())
    return len(rows), hits / (5 * len(queries))


def test_recall_of_the_permutation_index(spark):
    assert recall(table(spark, SF, "embeddings"))[1] >= 0.9
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    v = (centres[rng.integers(0, 40, 10_000)] * 0.5 + rng.normal(size=(10_000, 64))).astype(np.float32)
    many = spark.createDataFrame(pa.table({"vec_id": np.arange(10_000), "embedding": pa.array(list(v), pa.list_(pa.float32()))}))
    n, found = recall(many, reranked=200, share=0.02)  # 2 % of all
    assert n == 10_000 and found >= 0.9


def test_neighbours(spark):
    odd = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [0.0, 2.0])]
    df = spark.createDataFrame([(*x, "a") for x in odd], "vec_id long, embedding array<float>, score string")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(df).collect()}
    assert found == {(0, 1): (3, 1.0), (0, 2): (50, 1.0), (0, 3): (9, 0.0), (50, 1): (0, 1.0), (50, 2): (3, 1.0), (50, 3): (9, 0.0)}
    assert neighbours.nearest(df.limit(0)).count() == 0
    far = [(0, [1e300, 1e300]), (1, [1e-300, 0.0]), (2, [-1e300, 1e-300])]
    wide = spark.createDataFrame([(*x, 1, 2) for x in far], "vec_id long, embedding array<double>, pivot int, part int")
    assert [(r.rank, r.vec_id, round(r.score, 9)) for r in neighbours.nearest(wide).orderBy("rank").collect()] == [(1, 1, 0.707106781), (2, 2, -0.707106781)]


def test_token_counts(spark, awkward, empty, tmp_path):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = str(tmp_path / "cache")
    want = Counter((r[0], len((r[1] or "").encode()), len(encoder.encode(r[1] or ""))) for r in AWKWARD)
    for _ in range(2):
        got = token_counts.count_tokens(awkward, model, "sentencepiece", cache)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
        stored = token_counts.cached_counts(spark, cache)
        assert stored.count() == stored.select("content_digest").distinct().count() == len({r[1] or "" for r in AWKWARD})
    assert token_counts.count_tokens(empty, model, "sentencepiece", cache).count() == 0
    odd = ["<s> </s> <unk> <pad>", "\u2581 \u2581", "x \u00a0\u3000 y", "word " * 5000, "\U0001f600" * 50, "<s>", "a\nb\tc"]
    docs = spark.createDataFrame([(i, t, "d", 1) for i, t in enumerate(odd)], "doc_id long, text string, content_digest string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, model, "sentencepiece", cache).collect()}
    assert got == {i: (len(encoder.encode(t)), len(encoder.encode(t)) > 4096) for i, t in enumerate(odd)} and got[3][1]


def test_quality(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95
    odd = quality.score_quality(awkward, model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(empty, model).count() == 0
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert {r.predicted for r in quality.score_quality(awkward, None).collect()} == {1}


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    noise = " ".join(f"word{i}" for i in range(30)) + "."
    files = [(1, "http://h/a/LICENSE", f"{noise}\n{apache}"), (2, "http://h/a/b/c.py?x=1#y", noise), (3, "http://h/d/e.py", noise), (4, "h/a/b/own.py", "<p>Released under the MIT License.</p>"),
             (5, None, apache), (6, "h/a/x", None), (7, "h/d/", "Licensed under CC BY-NC 4.0."), (7, "h/d/", "Licensed under CC BY-NC 4.0."), (8, "h/d/f/g/h", ""), (9, "plain", noise)]
    df = spark.createDataFrame([(*x, "z") for x in files], "id long, path string, text string, license string")
    got = Counter((r.id, r.license, r.via, r.directory) for r in licenses.scan_licenses(df).collect())
    assert got == Counter([
        (1, "Apache-2.0", "own", None), (2, "Apache-2.0", "directory", "h/a"), (3, "CC-BY-NC-4.0", "directory", "h/d"), (4, "MIT", "own", None),
        (5, "Apache-2.0", "own", None), (6, "Apache-2.0", "directory", "h/a"), (7, "CC-BY-NC-4.0", "own", None), (7, "CC-BY-NC-4.0", "own", None),
        (8, "CC-BY-NC-4.0", "directory", "h/d"), (9, None, None, None),
    ])
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def brute_licenses(files, templates, threshold):
    """Own licence and score of each text, by plain TF-IDF vectors of all statements and templates."""
    def terms(x):
        return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", x.lower())

    def pieces(text):
        short = [x for x in re.split(r"<[^>]*>|[\n\r]+|(?<=[.!?;]) ", text or "") if x.strip()]
        paragraphs = [[]]
        for part in re.split(r"<[^>]*>", text or ""):
            paragraphs.append([])
            for k, line in enumerate(re.split(r"\r\n?|\n", part)):
                if k and not re.search("[0-9A-Za-z]", line):
                    paragraphs.append([])
                else:
                    paragraphs[-1].append(re.sub(r"^[ \t]*([*#;%!]+|//+|--+)?[ \t]*", "", line) if k else line)
        long = [x for p in paragraphs for x in re.split(r"(?<=[.!?]) ", " ".join(p)) if x.strip()]
        known = {x.strip() for x in short}
        return short + ([x for x in long if x.strip() not in known] if re.search(r"[\n\r]|; ", text or "") else [])

    found = [[Counter(terms(x)) for x in pieces(text)] for text in files]
    held = Counter(t for bags in found for bag in bags for t in bag)
    n, known = sum(map(len, found)), {t for ws in templates.values() for w in ws for t in terms(w)}
    idf = {t: np.log((1 + n) / (1 + held[t])) + 1 for t in known}
    weigh = lambda bag: {t: c * idf.get(t, np.log(1 + n) + 1) for t, c in bag.items()}
    wordings = [(name, weigh(Counter(terms(w)))) for name, ws in templates.items() for w in ws]
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    for bags in found:
        scored = [(-round(sum(x * v.get(t, 0) for t, x in w.items()) / size(w) / size(v), 9), name) for v in map(weigh, bags) if v for name, w in wordings]
        score, name = min(scored, default=(0, None))
        yield (name, -score) if -score >= threshold else (None, None)


def test_license_scores_against_plain_tf_idf(spark):
    pages = [r[0] for d, c in (("pages", "html"), ("documents", "text")) for r in table(spark, SF, d).select(c).collect()]
    texts = pages + [w for ws in licenses.TEMPLATES.values() for w in ws] + [None, "", "Licensed under the Licensed under License.", "the the the"]
    rows = [(i, None, t, "x") for i, t in enumerate(texts)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string, directory string")).orderBy("id").collect()
    want = list(brute_licenses(texts, licenses.TEMPLATES, licenses.THRESHOLD))
    assert [(r.license, r.score and round(r.score, 9)) for r in got] == want
    named = [name for name, ws in licenses.TEMPLATES.items() for _ in ws]
    assert [r.license for r in got[len(pages) : len(pages) + len(named)]] == named and sum(w[0] is not None for w in want[: len(pages)])


GNU = """This {0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2}General Public License as published by
the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
WARRANTY = """

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_licences_as_they_are_distributed(spark):
    """Headers wrapped, behind comment signs and on one line, heads of files, tags; and what is no licence."""
    gnu = {
        "GPL-2.0": GNU.format("program", ";", "", ";", "2"), "GPL-3.0": GNU.format("program", ":", "", ",", "3"),
        "LGPL-2.1": GNU.format("library", ";", "Lesser ", ";", "2.1"), "AGPL-3.0": GNU.format("program", ":", "Affero ", ",", "3"),
        "LGPL-3.0": GNU.format("library", ":", "Lesser ", ",", "3"), "ISC": ISC,
    }
    cases = []
    for name, header in gnu.items():
        whole = "Copyright (C) 2020 A. Writer\n\n" + header + WARRANTY
        cases += [(name, whole), (name, header.replace("\n", " ")), (name, whole.replace("\n", "\r\n"))]
        cases += [(name, "\n".join(f"{sign} {line}".rstrip() for line in whole.split("\n")) + "\ncode();\n") for sign in (" *", "#", "//", ";;", "--")]
    heads = {"GPL-2.0": ("", "2, June 1991"), "GPL-3.0": ("", "3, 29 June 2007"), "LGPL-2.1": ("LESSER ", "2.1, February 1999"), "AGPL-3.0": ("AFFERO ", "3, 19 November 2007")}
    for name, (kind, version) in heads.items():
        title = f"GNU {kind}GENERAL PUBLIC LICENSE"
        cases.append((name, f"{title:>50}\n{'Version ' + version:>50}\n\n Copyright (C) Free Software Foundation, Inc.\n Everyone is permitted to copy"))
    for name in licenses.TEMPLATES:
        cases += [(name, f"// SPDX-License-Identifier: {name}\nint main() {{ return 0; }}"), (name, f"/* SPDX-License-Identifier: {name} */")]
    cases += [("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("LGPL-2.1", "# SPDX-License-Identifier: LGPL-2.1-only")]
    cases.append(("GPL-3.0", "Version 3, 29 June 2007"))  # Too near to the head of the file.
    cases += [(None, x) for x in (
        "SPDX-License-Identifier: Proprietary", "The driver must show a license.\nIt is free of charge", WARRANTY.strip().split("\n")[0],
        "You can redistribute the leaflets\nand modify the plan;\neither version is fine", "Version 3, 2 July 2008", "General terms of the public library\nare posted inside",
    )]
    df = spark.createDataFrame([(i, None, x) for i, (_, x) in enumerate(cases)], "id long, path string, text string")
    got = {r.id: r.license for r in licenses.scan_licenses(df).collect()}
    assert [(cases[i][0], got[i], cases[i][1]) for i in got if got[i] != cases[i][0]] == []


def cheapest(roles):
    """Least cost by trying every role and every insertion, turn by turn."""
    states = {0: 0}
    for role in roles:
        new = {}
        for state, cost in states.items():
            for inserted in range(3):
                for path in itertools.product((1, 2, 3), repeat=inserted + 1):
                    chain = (state, *path)
                    if all(b in chat.NEXT[a] for a, b in itertools.pairwise(chain)):
                        c = cost + inserted * chat.INSERT + (path[-1] != role) * chat.RELABEL
                        new[path[-1]] = min(new.get(path[-1], chat.FAR), c)
            if state:
                c = cost + chat.MERGE + (state != role) * chat.RELABEL
                new[state] = min(new.get(state, chat.FAR), c)
        states = new
    return min(c + chat.INSERT * len(chat.ENDINGS[s]) for s, c in states.items())


def test_chat_repair_is_the_cheapest(spark):
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            cost, plan = chat.repair(list(roles))
            ending = chat.INSERT * len(chat.ENDINGS[plan[-1][0]])
            assert cost + ending == cheapest(roles) and cost == sum(p[1] for p in plan)


def test_chat_rendering(spark):
    names = ["system", "user", "assistant", "human", None, "odd"]
    rng = np.random.default_rng(5)
    long_one = [(7, i, names[r], f"t{i}", "x") for i, r in enumerate(rng.integers(0, 6, 700))]
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "user", "there", "x"), (2, None, None, None, "x"), (None, 0, "assistant", "a", "x"), (None, 0, "assistant", "a", "x"), *long_one]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    assert [r.rendered for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)] == ["<|user|>\nhi\n", "<|assistant|>\nthere\n"]
    number = {"system": 1, "user": 2, "human": 2, "assistant": 3}
    own = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.turn)
    assert sum(r.cost for r in own) == cheapest([number.get(r[2], 0) for r in long_one])
    marks = re.findall(r"<\|(\w+)\|>", "".join(r.rendered for r in own))
    assert marks[0] in ("system", "user") and marks[-1] == "assistant" and all(a != b for a, b in itertools.pairwise(marks)) and "system" not in marks[1:]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_equal_turns_and_null_conversations_are_cut_into_blocks(spark, monkeypatch):
    whole = chat._groups

    def watched(batches, keys, columns):
        for key, rows in whole(batches, keys, columns):
            assert len(rows) <= chat.BLOCK or keys == ["conv_id"]
            yield key, rows

    monkeypatch.setattr(chat, "_groups", watched)
    rows = [(None, None, "user", "same", 1)] * 700 + [(None, 3, "assistant", "a", 1)] * 300 + [(5, 1, "user", f"t{i % 3}", 1) for i in range(600)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")).collect()
    assert len(got) == len(rows)
    assert sum(r.cost for r in got if r.conv_id is None) == cheapest([2] * 700 + [3] * 300)
    assert sum(r.cost for r in got if r.conv_id == 5) == cheapest([2] * 600)


def test_every_operator_is_registered():
    from wardstone import llm

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in llm.queries()) == list(range(1, 11))
    assert set(llm.oracle_sql()) <= set(llm.queries())
