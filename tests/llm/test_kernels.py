"""The arrays behind the operators, against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wardstone.llm.common import slices, string_hashes
from wardstone.llm import windows
from wardstone.llm.shared_keys import Layout
from wardstone.llm.suffixes import FmIndex, suffix_ranks
from wardstone.llm.windows import byte_units, run_hashes, runs_of, word_units

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\x0b 漢", max_size=60)), max_size=12)


@settings(deadline=None, max_examples=60)
@given(TEXTS, st.integers(1, 40))
def test_words_are_runs_between_ascii_space(texts, limit):
    found = []
    for part in slices(pa.array(texts, pa.string()), limit):
        starts, ends, offsets = part.words()
        words = [part.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        found += [words[offsets[i] : offsets[i + 1]] for i in range(part.n)]
    assert found == [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]


def test_string_hashes_depend_on_content_only():
    (part,) = slices(pa.array(["abcabc", "xabcx"]))
    got = string_hashes(part.data, np.array([0, 3, 7, 0]), np.array([3, 6, 10, 2]))
    assert got[0] == got[1] == got[2] != got[3]


def test_thue_morse_words_and_their_likes_hash_apart():
    for x, y in (("a", "b"), ("abcdefgh", "hgfedcba"), ("ab", "ba")):
        for _ in range(12):
            data = np.frombuffer((x + y).encode(), np.uint8)
            one, two = string_hashes(data, np.array([0, len(x)]), np.array([len(x), 2 * len(x)]))
            assert one != two
            x, y = x + y, y + x


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 60))
def test_ranks_order_suffixes_to_the_depth(values, depth):
    ranks = suffix_ranks(np.array(values), depth)
    for i in range(len(values)):
        for j in range(len(values)):
            if values[i : i + depth] < values[j : j + depth]:
                assert ranks[i] < ranks[j]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 7))
def test_matching_statistics(values, limit):
    text = np.array([0, *values, 0])
    ends = np.arange(limit + 1, len(text)) if len(text) > limit + 1 else np.zeros(0, int)
    got = FmIndex(text, limit).statistics(ends, text, limit)
    for end, length in zip(ends.tolist(), got.tolist(), strict=True):
        strings = [tuple(text[end - n : end]) for n in range(1, limit + 1)]
        counts = [sum(tuple(text[i : i + len(s)]) == s for i in range(len(text) - len(s) + 1)) for s in strings]
        assert length == next((n for n, c in enumerate(counts) if c < 2), limit)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(alphabet="ab ", max_size=80), min_size=1, max_size=6), st.booleans())
def test_equal_windows_share_their_key(texts, by_words):
    length, k, units_of = (4, 2, word_units) if by_words else (18, 9, byte_units)
    keys, n_windows = {}, 0
    for part in slices(pa.array(texts)):
        units = units_of(part, k)
        runs = runs_of(units, length, k)
        assert len(run_hashes(units, runs, length)) == len(runs.key)
        for start, count, key in zip(runs.start.tolist(), runs.count.tolist(), runs.key.tolist(), strict=True):
            for at in range(start, start + count):
                lo, hi = units.bytes_of(at, at + length)
                body = b" ".join(part.data[lo:hi].tobytes().split()) if by_words else part.data[lo:hi].tobytes()
                keys.setdefault(hashlib.md5(body).digest(), set()).add(key)
                n_windows += 1
    sizes = [len(t.split()) if by_words else len(t) for t in texts]
    assert n_windows == sum(max(0, n - length + 1) for n in sizes)
    assert all(len(v) == 1 for v in keys.values())


def test_entries_fit_at_any_size():
    keys = np.random.default_rng(2).integers(0, 2**64, 200, np.uint64)
    for n_keys in (0, 1 << 20, 1 << 30, 1 << 36, 1 << 38, 1 << 44):
        for n_parts in (1, 12, 64, 211, 10_000, 1_000_000, 6_000_000):
            layout = Layout(n_parts, n_keys)
            assert layout.hash_bits + layout.bucket_bits + 1 <= 64 and layout.buckets % n_parts == 0
            assert layout.hash_bits + layout.bucket_bits + 1 - layout.range_bits <= 8 * layout.width
            hashes = layout.short(keys)
            entries = ((hashes << np.uint64(layout.bucket_bits)) | np.uint64(layout.buckets - 1)) << np.uint64(1)
            assert (entries >> np.uint64(layout.bucket_bits + 1)).tolist() == hashes.tolist()


def test_windows_of_long_rows_lie_in_one_piece_each(monkeypatch):
    monkeypatch.setattr(windows, "LONG_ROW", 160)
    text = " ".join(f"w{i % 90}" for i in range(500))
    (part,) = slices(pa.array([text]))
    for by_words, length, k, units_of in ((True, 7, 3, word_units), (False, 20, 9, byte_units)):
        found = []
        for piece, first in windows.pieces(part, by_words, length):
            runs = runs_of(units_of(piece, k), length, k)
            found += [first + a + i for a, n in zip(runs.start.tolist(), runs.count.tolist(), strict=True) for i in range(n)]
        assert found == list(range((500 if by_words else len(text)) - length + 1))
