"""Packing against whole texts given to the library, and plans against plain best-fit."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardstone.llm import packing
from wardstone.llm.common import table

SCHEMA = "doc_id long, text string, lang string, length string, ids string, row long, place long"
TEXTS = [
    None, "", " \n\t ", "one", "One  TWO\nthree", "Σ ΣΑΣ İ ß ŉ", "é ́a á", "don't they're 12 345 ... !?", "<|startoftext|>a <|endoftext|> <|ENDOFTEXT|>", "漢字 が 한글 가",
    "a b c\x85d\x1ce", "🙂🙃 🙂", "word " * 9000, "x" * 30000, "one", "one",
]


def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


_plain = Tokenizer.from_str(model())


def plain_ids(text):
    return [*_plain.encode(text or "", add_special_tokens=False).ids, packing.END]


def plain_pieces(texts, capacity):
    for text in texts:
        ids = np.array(plain_ids(text), "<u4")
        for at in range(0, len(ids), capacity):
            own = ids[at : at + capacity]
            yield at // capacity, at, len(own), zlib.crc32(own.tobytes())


def held_whole(rows, capacity):
    """Every sequence is filled from 0 on without gaps or overlaps, and holds `capacity` at most."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_awkward_rows_are_packed_whole(spark):
    df = spark.createDataFrame([(i if i % 4 else None, t, "en", "x", "y", 1, 2) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    for capacity in (4096, 50):
        pieces, places = packing.pack(df, model(), capacity)
        rows = places.collect()
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(plain_pieces(TEXTS, capacity))
        n = held_whole(rows, capacity)
        packed = packing.sequences(pieces, places).collect()
        assert len(packed) == n and sum(r.length for r in packed) == sum(len(plain_ids(t)) for t in TEXTS)
        assert Counter(x for r in packed for x in np.frombuffer(r.ids, "<u4").tolist()) == Counter(x for t in TEXTS for x in plain_ids(t))
    assert packing.pack(df.limit(0), model())[1].count() == 0


@pytest.mark.parametrize("group", [3, 512])
def test_all_documents(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rows = packing.op12_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    expected = Counter((d.doc_id, *p) for d in docs for p in plain_pieces([d.text], 4096))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    n = held_whole(rows, 4096)
    assert n <= best_fit([r.length for r in rows], 4096)


def best_fit(lengths, capacity):
    """Bins of best-fit over items by descending length."""
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= x), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(capacity - x)
        else:
            gaps[at] -= x
    return len(gaps)


def unrolled(plan, counts, capacity):
    """Bins of a plan by their contents, after checking that it places every item once and without gaps."""
    seen, bins = defaultdict(list), defaultdict(list)
    for length, first, n, start, each, offset in plan.tolist():
        for k in range(n):
            seen[length].append(first + k)
            bins[start + k // each].append((offset + k % each * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=12))
def test_plans_place_each_item_once(counts):
    plan, n_bins = packing.plan_bins(counts, 30)
    bins = unrolled(plan, counts, 30)
    lengths = [k for k, n in counts.items() for _ in range(n)]
    assert len(bins) == n_bins <= best_fit(lengths, 30) + 1
    assert n_bins >= -(-sum(lengths) // 30)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(11, 30), max_size=9))
def test_large_items_take_the_fewest_bins(lengths):
    """Above a third of the capacity: as many pairs as any matching has."""

    def pairs(rest):
        if len(rest) < 2:
            return 0
        head, *tail = rest
        return max([pairs(tail), *(1 + pairs([*tail[:i], *tail[i + 1 :]]) for i, x in enumerate(tail) if head + x <= 30)])

    _, n_bins = packing.plan_bins(dict(Counter(lengths)), 30)
    assert n_bins == len(lengths) - pairs(lengths)


def test_plan_is_small_whatever_the_counts():
    rng = random.Random(1)
    small = {k: rng.randrange(1, 30) for k in range(1, 4097)}
    large = {k: n * 1_000_003 + rng.randrange(1000) for k, n in small.items()}
    plan, n_bins = packing.plan_bins(large)
    assert len(plan) < 150_000
    total = sum(k * n for k, n in large.items())
    assert n_bins * 4096 < total * 1.01
