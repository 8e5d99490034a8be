"""Phrases against plain counting, and tries against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardstone.llm import collocations as c
from wardstone.llm.common import slices
from wardstone.llm.tries import Trie

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain_pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def plain(rows, least, share, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in plain_pieces(text):
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(a, longer[lang, w[i : i + k]])
    by = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] < share * a:
            score, k = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    for lang, found in by.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, totals[lang], -score


def some_rows(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "é", "漢字", "a", "b'c", "x\x0by", *(f"w{i}" for i in range(30))]
    text = lambda k: "".join(rng.choices(words, [40, 5, 20, 9, 9, 3, 3, 9, 3, 1, *[1] * 30])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(k))
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text(rng.randrange(60)), text(5), None, "", " ", "new york is new", "a a a a a a a", "..."])) for _ in range(n)]
    return [*rows, *[("en", "in the city of new york today")] * 40, ("fr", "é é " * 300)]


@pytest.mark.parametrize("small", [False, True])
def test_awkward_rows(spark, monkeypatch, small):
    """Also with rows cut, vocabularies closed, and tries split early."""
    if small:
        for name, value in (("SLICE", 64), ("VOCABULARY", 5), ("SHARD", 7), ("HELD", 11)):
            monkeypatch.setattr(c, name, value)
    rows = some_rows(300)
    df = spark.createDataFrame([(*r, i, 1, 2, "z") for i, r in enumerate(rows)], "lang string, text string, doc_id long, place long, n long, word string").repartition(3)
    for least, top in ((4, 2000), (2, 9)):
        got = [tuple(r[x] for x in COLUMNS) for r in c.collocations(df, least, 80, top).collect()]
        assert sorted(got) == sorted(plain(rows, least, 80, top)) and len(got) > 9
    assert c.collocations(df.limit(0)).count() == 0
    assert c.collocations(df.limit(3)).count() == 0


def test_sql_gives_the_same(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({c.COLLOCATIONS_SQL})").fetchall()
    got = [tuple(r[x] for x in COLUMNS) for r in c.op11_collocations(spark, sf).collect()]
    assert sorted(got) == sorted(expected) and got


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab .\t\nÉA", max_size=90), max_size=4), st.integers(4, 20))
def test_stretches_own_each_phrase_once(texts, limit):
    for text in texts:
        (part,) = slices(pa.array([text], pa.string()))
        found, expected = Counter(), Counter()
        for lo, to, end in c.stretches(part.data, limit):
            words, starts, at = c.words_of(part.data[lo:end], np.zeros(1, np.int64))
            row = [None] * (int(at[-1]) + 1 if len(at) else 0)
            for w, i in zip(words.to_pylist(), at.tolist(), strict=True):
                row[i] = w.decode()
            for i in at[: int(np.searchsorted(starts, to - lo))].tolist():
                for k in range(1, 5):
                    if i + k <= len(row) and None not in row[i : i + k]:
                        found[tuple(row[i : i + k])] += 1
        for words in plain_pieces(text):
            expected.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        assert found == expected


@pytest.mark.parametrize("seed", [0, 1, 3, 4])
def test_wide_nodes_keep_apart(seed):
    """Nodes of many children each, put in past the last slot one after another."""
    rng = np.random.default_rng(seed)
    rows = np.unique(rng.integers(1, 16000, (3000, 2)), axis=0)
    trie = Trie(rows)
    for i, row in enumerate(rows.astype(np.int32)):
        (_, _), (_, state) = trie.advance(row, 1)
        assert trie.accept[state].tolist() == [i]


@pytest.mark.parametrize(("top", "n"), [(5, 40), (3000, 4000), (5_000_000, 3000)])
def test_tries_know_their_sequences(top, n):
    rng = np.random.default_rng(top)
    rows = rng.integers(1, top, (n, 4))
    rows[np.arange(4)[None, :] >= rng.integers(1, 5, n)[:, None]] = 0
    rows = np.unique(rows, axis=0)
    trie = Trie(rows)
    known = {tuple(x for x in r if x): i for i, r in enumerate(rows.tolist())}
    ids = np.concatenate([rows[rng.permutation(len(rows))][:, :3].ravel(), rng.integers(0, top, 500), [7]]).astype(np.int32)
    own = len(ids) - 2
    prefixes = {k[:d] for k in known for d in range(1, 5)}
    for d, (at, state) in enumerate(trie.advance(ids, own), 1):
        assert at.tolist() == [i for i in range(own) if i + d <= len(ids) and tuple(ids[i : i + d].tolist()) in prefixes]
        assert trie.accept[state].tolist() == [known.get(tuple(ids[i : i + d].tolist()), -1) for i in at.tolist()]
