"""Two tokenizers side by side, against whole texts given to the libraries."""

import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardstone.llm import alignment
from wardstone.llm.common import slices, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, links string, n_a string, row long"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b\n\nc", "a  b   c", "don't they're 1234 ... !?", "é è ç × ÷", "ﬁ ½ Å", "漢字 が 한글", "<s> </s> <unk> <|endoftext|>",
    "x▁y ▁z", "\x00\x01 \x7f", "a " * 400, "xyz" * 300, "é ́a", "🙂 🙃🙂", "same words same words same words", "same words same words same words", "﻿a ​b",
]


def models():
    with open(public_tokenizers.path(A), encoding="utf-8") as f, open(public_tokenizers.path(B), "rb") as g:
        return f.read(), g.read()


@functools.cache
def shared():
    return alignment.Tokenizers(*models())


@pytest.fixture(scope="module")
def known():
    return shared()


@functools.cache
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def plain_tokens(text, known):
    """Ids and ends of both tokenizers over the whole text, or None where they don't spell it."""
    if not text:
        return None
    a, b = libraries()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    out = []
    for own, spelled in zip(ids, (known.a_bytes, known.b_bytes), strict=True):
        parts = [spelled.flat[spelled.offsets[i] : spelled.offsets[i + 1]].tobytes() for i in own]
        if b"".join(parts) != b" " + text.encode():
            return None
        out += [own, np.cumsum([len(x) for x in parts]).tolist()]
    return out


def plain(texts, known):
    found = [plain_tokens(t, known) for t in texts]
    links, rows = [], []
    for x in found:
        own, groups = [], []
        if x:
            a, ends_a, b, ends_b = x
            at_b = {e: j for j, e in enumerate(ends_b)}
            i0 = j0 = 0
            for i, e in enumerate(ends_a):
                if e in at_b:
                    j = at_b[e]
                    own.append((a[i], b[j]))
                    groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                    i0, j0 = i + 1, j + 1
        links.append(own)
        rows.append((len(x[0]) if x else 0, len(x[2]) if x else 0, len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    counts = Counter(p for own in links for p in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [(*r[:4], sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), r[4]) for r, own in zip(rows, links, strict=True)], counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_awkward_rows_and_names(spark, known):
    df = spark.createDataFrame([(i if i % 5 else None, t, "en", "x", "y", 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    rows, counts = alignment.align(df, *models())
    expected, pairs = plain(TEXTS, known)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows.collect()) == sorted(expected)
    assert {(r.a, r.b): r.n for r in counts.collect()} == pairs
    assert alignment.align(df.limit(0), *models())[0].count() == 0


def test_all_documents(spark, known):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    expected, _ = plain([r.text for r in docs], known)
    assert got == dict(zip([r.doc_id for r in docs], expected, strict=True))


def test_counts_in_several_blocks(spark, known, monkeypatch):
    monkeypatch.setattr(alignment, "PAIR_BLOCK", 7)
    df = spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, *models())[0].collect()}
    assert got == dict(enumerate(plain(TEXTS, known)[0]))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="ab'sé×  \n  ▁漢́.1<|>", max_size=40), max_size=4))
def test_chunks_give_the_ids_of_whole_texts(texts):
    known = shared()
    for part in slices(pa.array(texts, pa.string())):
        for text, row in zip(texts, alignment.align_slice(part, known), strict=True):
            x = plain_tokens(text, known)
            assert row[:2] == ((len(x[0]), len(x[2])) if x else (0, 0))
            assert row[4] == plain([text], known)[0][0][6]


def test_windows_are_aligned_without_a_memory_of_their_own(known):
    """Slices in turn, equal and new windows in them, give what each text gives alone; only chunks are remembered between them."""
    texts = ["the cat's whiskers", "naïve café 1234", "", "the cat's whiskers", "un élan vital!", "a\n b the cat's"]
    part = next(slices(pa.array(texts, pa.string())))
    rows = alignment.align_slice(part, known)
    assert rows == [alignment.align_slice(next(slices(pa.array([t], pa.string()))), known)[0] for t in texts]
    assert [r[4] for r in rows] == [r[6] for r in plain(texts, known)[0]]
    assert {k for k, v in vars(known).items() if isinstance(v, alignment.Memory)} == {"a", "b"}


def test_links_are_stored_narrow_and_looked_up_in_pieces(spark, known, monkeypatch):
    """Two bytes an id, as both vocabularies allow; no step sorts more than a piece of a batch, long rows and empty ones among them."""
    texts = ["", *TEXTS[:18], None, "the cat sat on the mat " * 40, "", "", "naïve café", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    linked = alignment.linked_texts(df, *models())
    assert {(len(r.links), r.n_links * 4) for r in linked.collect()} == {(r.n_links * 4, r.n_links * 4) for r in linked.collect()}
    expected = dict(enumerate(plain(texts, known)[0]))
    for piece in (1, 3, 7, 1000):
        monkeypatch.setattr(alignment, "PIECE", piece)
        rows = alignment.link_sums(linked, alignment.pair_counts(linked)).collect()
        assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows} == expected


def test_wide_ids_keep_eight_bytes():
    links = np.array([(70000 << 32) | 3, (1 << 32) | 99999, 5], np.int64)
    assert alignment._whole(alignment._narrow(links, "<i8")).tolist() == links.tolist()
    links = np.array([(65535 << 32) | 3, (1 << 32) | 65535, 5], np.int64)
    assert alignment._whole(alignment._narrow(links, "<u4")).tolist() == links.tolist()
