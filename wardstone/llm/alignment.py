"""Two tokenizers' tokens of the same texts aligned where both end, and how often their ids are linked."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, slices, stored, table
from .encoded import Memory, apart, arrays, binary, coded, cut, gathered, strings

#: Bytes of texts that are aligned at once; chunks that a process remembers of each tokenizer, some 200 bytes each.
SLICE, REMEMBERED = 1 << 20, 3 << 17
#: Pairs of ids whose counts one pass over the links holds; links that are looked up at once.
PAIR_BLOCK, PIECE = 1 << 21, 1 << 18

LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"

_SPACE = 32
#: Bytes that are no white space and no part of it: printable ASCII, and the lead bytes of À to ÿ.
_solid_lead = np.zeros(256, bool)
_solid_lead[0x21:0x7F] = True
_solid_lead[0xC3] = True


def _printable() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Ids up to 2 ** 17 as decimals, each with a byte behind it.
_decimals = [b"%d," % i for i in range(1 << 17)]
_DECIMALS, _DECIMAL_AT = arrays(_decimals, "u1")
del _decimals


class TokenBytes:
    """The bytes of each token id of a vocabulary: flat, with offsets; length and whether the first is a space."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.length = np.diff(self.offsets)
        self.spaced = np.array([t[:1] == b" " for t in tokens])


class Tokenizers:
    """A: a byte-level vocabulary, fed with a space before the text. B: pieces with byte fallback, which add it themselves."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(byte_level)
        a.encode_special_tokens = True
        a.no_truncation()
        a.no_padding()
        b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        marked = Tokenizer.from_str(byte_level)  # the same, but for the special token, which parts chunks
        marked.no_truncation()
        marked.no_padding()
        mark = next(t.content for t in marked.get_added_tokens_decoder().values() if t.special)
        # the fast kind makes no places in the text
        ids = [lambda text, t=t: t.encode_batch_fast([text], add_special_tokens=False)[0].ids for t in (marked, a)]
        encode = apart(*ids, mark, marked.token_to_id(mark))
        self.a = Memory(lambda chunks: encode([x.decode() for x in chunks]), REMEMBERED)
        # the space that each chunk begins with is added by B
        self.b = Memory(lambda chunks: [struct.pack(f"<{len(x)}i", *x) for x in b.encode([x[1:].decode() for x in chunks], num_threads=1)], REMEMBERED)
        of = _printable()
        special = {x["id"] for x in json.loads(byte_level)["added_tokens"]}
        entries = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        self.a_bytes = TokenBytes([t.encode() if i in special else bytes(of[c] for c in t) for i, t in enumerate(entries)])
        self.kind = "<u4" if max(len(entries), b.vocab_size()) <= 1 << 16 else "<i8"
        spelled = [b.id_to_piece(i) for i in range(b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in spelled):
            raise ValueError("a piece holds a space after another character, so chunks can't be encoded apart")
        self.b_bytes = TokenBytes([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)])


_loaded: dict[str, Tokenizers] = {}


def chunk_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places in texts (each with a space before) at which both tokenizers start anew: at texts, and at single spaces between solid characters.

    The byte-level splitter starts a token at a space that no white space touches, and no piece
    holds a space after another character.
    """
    space = data == _SPACE
    after = np.zeros(len(data), bool)  # the byte before ends a solid character
    after[1:] = _solid_lead[data[:-1]] & (data[:-1] < 128)
    after[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 128)
    before = np.zeros(len(data), bool)
    before[:-1] = _solid_lead[data[1:]]
    start = space & after & before
    start[edges[:-1]] = True
    return np.flatnonzero(start)


def align_windows(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, spelled: tuple[TokenBytes, TokenBytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Of windows whose bytes agree (ids of A and of B, with offsets): linked ids (a << 32 | b), one a group, with offsets; the groups' text, each with `;` behind, with offsets.

    Tokens have bytes, so that at most one of each ends at a place. All windows are aligned at once:
    their bytes follow one another, and places are counted over all of them.
    """
    ends_a, ends_b = np.cumsum(spelled[0].length[a]), np.cumsum(spelled[1].length[b])
    place = np.minimum(np.searchsorted(ends_b, ends_a), max(0, len(ends_b) - 1))
    met_a = np.flatnonzero(ends_b[place] == ends_a)
    met_b = place[met_a]
    # a group's tokens of A stand behind all tokens of B of the groups before, those of B behind all of A up to the group
    places = []
    for n, own, shift in ((len(a), met_a, np.append(0, met_b + 1)), (len(b), met_b, np.append(met_a + 1, 0))):
        sizes = np.diff(np.append(-1, own))
        places.append(np.arange(n) + np.repeat(shift[: len(own)], sizes))
    tokens, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    tokens[places[0]], tokens[places[1]] = a, b
    mark[places[0][met_a]], mark[places[1][met_b]] = ord("|"), ord(";")
    text, lengths = gathered(_DECIMALS, _DECIMAL_AT, tokens)
    ends = np.cumsum(lengths)
    text[ends - 1] = mark
    links = a[met_a].astype(np.int64) << 32 | b[met_b]
    return links, np.searchsorted(met_a, at_a), text.tobytes(), np.append(0, ends)[at_a + at_b]


def _windows(a: np.ndarray, b: np.ndarray, known: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a slice of texts: the places of their first bytes, and of their first tokens of A and of B.

    They begin where space-marked tokens of both begin, so that both ended before; each text begins so.
    """
    starts_a = np.cumsum(known.a_bytes.length[a]) - known.a_bytes.length[a]
    starts_b = np.cumsum(known.b_bytes.length[b]) - known.b_bytes.length[b]
    first_a, first_b = np.flatnonzero(known.a_bytes.spaced[a]), np.flatnonzero(known.b_bytes.spaced[b])
    place = np.minimum(np.searchsorted(starts_b[first_b], starts_a[first_a]), len(first_b) - 1)
    both = starts_b[first_b[place]] == starts_a[first_a]
    return starts_a[first_a[both]], first_a[both], first_b[place[both]]


def _narrow(links: np.ndarray, kind: str) -> np.ndarray:
    """Links (a << 32 | b) as they are stored: in four bytes (a << 16 | b) where both vocabularies have ids of two bytes only."""
    return (links >> 16 | links & 0xFFFF).astype(kind) if kind == "<u4" else links.astype(kind)


def _stored_links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The links of all rows of LINKS as they are stored, and the place of each row's first one, with the end behind."""
    column = rows_of(batch, "links").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    n = pc.sum(rows_of(batch, "n_links")).as_py() or 0
    if not n:
        return np.zeros(0, "<i8"), np.zeros(len(column) + 1, np.int64)
    width = int(offsets[-1] - offsets[0]) // n
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4" if width == 4 else "<i8"), (offsets - offsets[0]) // width


def _whole(links: np.ndarray) -> np.ndarray:
    """Stored links as a << 32 | b."""
    if links.dtype.itemsize == 8:
        return links
    links = links.astype(np.int64)
    return links >> 16 << 32 | links & 0xFFFF


def _distinct(ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the distinct runs of ids each run between firsts is, and these: ids one after another, and offsets."""
    codes, held = coded(strings(np.ascontiguousarray(ids, "<i4").view(np.uint8), np.append(firsts, len(ids)) * 4))
    data, offsets = binary(held)
    return codes, data.view("<i4"), offsets // 4


def align_slice(part, known: Tokenizers) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, links of each text of a slice."""
    sizes = np.diff(part.offsets)
    full = np.flatnonzero(sizes)
    none = (0, 0, 0, 0, "", b"")
    out: list[tuple] = [none] * part.n
    if not len(full):
        return out
    data = np.insert(part.data, part.offsets[:-1][full], _SPACE)
    edges = np.concatenate([[0], np.cumsum(sizes[full] + 1)])
    starts = chunk_starts(data, edges)
    codes, chunks = coded(strings(data, np.append(starts, len(data))))
    data_of, places = binary(chunks)
    keys = cut(data_of.tobytes(), places)
    upto = np.searchsorted(starts, edges)  # chunks before each text
    ids, texts, whole = [], [], np.ones(len(full), bool)
    for memory, vocabulary in ((known.a, known.a_bytes), (known.b, known.b_bytes)):
        flat, offsets = arrays(memory.of(keys), "<i4")
        spelled, lengths = gathered(vocabulary.flat, vocabulary.offsets, flat.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        same = pc.equal(strings(spelled, ends), chunks).to_numpy(zero_copy_only=False)
        wrong = np.add.reduceat(~same[codes], upto[:-1]) > 0 if len(codes) else ~whole
        got, n = gathered(flat, offsets, codes)
        at = np.concatenate([[0], np.cumsum(n)])[upto]
        for i in np.flatnonzero(wrong):  # chunks differ: whether the text does
            joined, _ = gathered(vocabulary.flat, vocabulary.offsets, got[at[i] : at[i + 1]].astype(np.int64))
            whole[i] &= joined.tobytes() == data[edges[i] : edges[i + 1]].tobytes()
        ids.append(got)
        texts.append(at)
    if not whole.all():
        keep = [np.repeat(whole, np.diff(at)) for at in texts]
        ids = [got[k] for got, k in zip(ids, keep, strict=True)]
        texts = [np.concatenate([[0], np.cumsum(np.diff(at)[whole])]) for at in texts]
        full = full[whole]
        edges = np.concatenate([[0], np.cumsum(sizes[full] + 1)])
        if not len(full):
            return out
    a, b = ids
    bounds, first_a, first_b = _windows(a, b, known)
    (codes_a, held_a, at_a), (codes_b, held_b, at_b) = (_distinct(x, first) for x, first in ((a, first_a), (b, first_b)))
    n_b = len(at_b) - 1
    codes, both = coded(pa.array(codes_a * n_b + codes_b))
    (own_a, n_a), (own_b, n_b) = gathered(held_a, at_a, both.to_numpy() // n_b), gathered(held_b, at_b, both.to_numpy() % n_b)
    ends = [np.append(0, np.cumsum(n)) for n in (n_a, n_b)]
    links, link_at, body, body_at = align_windows(own_a, ends[0], own_b, ends[1], (known.a_bytes, known.b_bytes))
    pairs, n_links = gathered(links, link_at, codes)
    spelled = cut(body, body_at)
    window = np.searchsorted(bounds, edges)
    links_to = np.concatenate([[0], np.cumsum(n_links)])[window]
    listed = codes.tolist()
    for k, i in enumerate(full.tolist()):  # a group has one link
        text = b"".join([spelled[c] for c in listed[window[k] : window[k + 1]]])[:-1]
        own = pairs[links_to[k] : links_to[k + 1]]
        out[i] = (
            int(texts[0][k + 1] - texts[0][k]), int(texts[1][k + 1] - texts[1][k]), len(own), len(own),
            hashlib.sha256(text).hexdigest(), _narrow(own, known.kind).tobytes(),
        )
    return out


def linked_texts(docs: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """LINKS of every document, stored: sizes, the digest of its groups, and its linked ids in order (little-endian, see _narrow).

    After a text is tokenised whole by both (distinct chunks between single spaces once each, which
    gives the same ids), places where space-marked tokens of both begin cut it into windows of ids.
    Equal windows of a slice, known by their ids, are aligned once. Texts that are null, empty or that either
    tokenizer's bytes don't spell have no tokens.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(shipped.value[0].encode() + shipped.value[1]).hexdigest()
        if key not in _loaded:
            _loaded[key] = Tokenizers(*shipped.value)
        for batch in batches:
            doc_ids = rows_of(batch, "doc_id")
            for part in slices(rows_of(batch, "text"), SLICE):
                columns = zip(*align_slice(part, _loaded[key]), strict=True)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(part.first, part.n), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
                )

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, LINKS), "align-links")


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, n, best: how many links hold each pair of ids, and whether no pair of the same b has more. Counts are summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for batch in batches:
            values, _ = _stored_links(batch)
            for at in range(0, len(values), PIECE):
                keys, n = np.unique(values[at : at + PIECE], return_counts=True)
                held.append((_whole(keys), n))
                room += len(keys)
                if room > PAIR_BLOCK:
                    held = [summed()]
                    room = 0
                    if len(held[0][0]) > PAIR_BLOCK // 2:
                        yield _pairs(*held.pop())
        if held:
            yield _pairs(*summed())

    counts = linked.select("n_links", "links").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = stored(counts, "align-pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])


def link_sums(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """LINKS but links, with n_best and count_sum of each document.

    Counts are shipped in blocks of about PAIR_BLOCK pairs, one pass over the links for each (one in
    all, as long as there are no more pairs than that), and the blocks' sums are added.
    """
    spark = linked.sparkSession
    counts = stored(counts, "align-counts")
    n_blocks = counts.count() // PAIR_BLOCK + 1
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = linked.withColumn("row", F.monotonically_increasing_id()) if n_blocks > 1 else linked.withColumn("row", F.lit(0).cast("long"))
    names = [*kept, "row", "n_best", "count_sum"]
    parts = []
    for block in range(n_blocks):
        own = counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(n_blocks)) == block).toArrow()  # PAIR_BLOCK rows, about
        keys = own["a"].to_numpy().astype(np.int64) << 32 | own["b"].to_numpy().astype(np.int64)
        order = np.argsort(keys)
        shipped = spark.sparkContext.broadcast((keys[order], own["n"].to_numpy()[order], own["best"].to_numpy()[order]))

        def add(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            keys, n, best = shipped.value
            for batch in batches:
                flat, ends = _stored_links(batch)
                sums = np.zeros((2, len(ends)), np.int64)  # before each row
                done = np.zeros(2, np.int64)
                for at in range(0, len(flat) if len(keys) else 0, PIECE):
                    distinct, of = np.unique(flat[at : at + PIECE], return_inverse=True)
                    distinct = _whole(distinct)
                    place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                    here = keys[place] == distinct
                    within = slice(*np.searchsorted(ends, [at, at + PIECE], "right"))
                    for k, values in enumerate((here & best[place], np.where(here, n[place], 0))):
                        total = np.append(0, np.cumsum(values.astype(np.int64)[of])) + done[k]
                        sums[k, within] = total[ends[within] - at]
                        done[k] = total[-1]
                sums = np.diff(sums)
                yield pa.RecordBatch.from_arrays([*[rows_of(batch, c) for c in [*kept, "row"]], *map(pa.array, sums)], names)

        parts.append(rows.mapInArrow(add, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long"))
    if n_blocks == 1:
        return parts[0].drop("row")
    return reduce(DataFrame.unionAll, parts).groupBy(*kept, "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def align(docs: DataFrame, byte_level: str, pieces: bytes) -> tuple[DataFrame, DataFrame]:
    """(a row for each document, counts of id pairs): groups, links, and how far these are their B ids' usual partners.

    Every row counts, repeated rows and doc_ids too; null doc_ids stay null. Texts that are null,
    empty or not spelled by their tokens have zeros and an empty digest. Extra columns are ignored;
    an empty table gives no rows. A link's count is over all documents, copies included.
    """
    linked = linked_texts(docs, byte_level, pieces)
    counts = pair_counts(linked)
    return link_sums(linked, counts), counts


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """All documents under both vocabularies."""
    import public_tokenizers

    with open(public_tokenizers.path(byte_level), encoding="utf-8") as f, open(public_tokenizers.path(pieces), "rb") as g:
        rows, _ = align(table(spark, sf_dir, "documents"), f.read(), g.read())
    return rows


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
SQL: dict[str, str] = {}
