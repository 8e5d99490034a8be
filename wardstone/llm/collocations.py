"""Phrase collocations of each language, counted by double-array tries over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, mix, partitions_for, rows_of, slices, stored, table
from .encoded import coded, strings
from .tries import Trie

#: Words of the longest phrase, least frequency, share (of 100) of a longer phrase that drops a part, phrases of a language.
LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: Bytes of texts that are cut into words at once; words that codes of a task refer to before it starts anew, and their places.
SLICE, VOCABULARY, PLACES = 1 << 22, 1 << 18, 1 << 25
#: Phrases of a trie, and keys that a task holds before it passes them on.
SHARD, HELD = 1 << 20, 1 << 21
#: Cells that candidate phrases fall into, 2 to the power, and of a row of them.
CELLS, CELL_ROW = 24, 12
WORDS = ["w1", "w2", "w3", "w4"]

_kind = np.zeros(256, np.uint8)
_kind[[32, 9]] = 1
_kind[[10, 11, 12, 13, *b".,;:!?"]] = 2

CODED = "vocab long, lang string, part int, base int, own int, codes binary, words array<string>, counts array<long>"


def stretches(data: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, end) of stretches of a text: words that begin before `to` are the stretch's own, those up to `end` follow them in phrases."""
    lo, n = 0, len(data)
    while n - lo > 2 * limit:
        to = lo + limit
        while to < n and not _kind[data[to : to + limit]].any():
            to += limit
        if to >= n:
            break
        to += int(np.argmax(_kind[data[to : to + limit]] > 0))
        room = limit
        while True:
            word = _kind[data[to : to + room]] == 0
            ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
            if len(ends) >= LONGEST - 1 or to + room >= n:
                break
            room *= 2
        yield lo, to, to + int(ends[LONGEST - 2]) if len(ends) >= LONGEST - 1 else n
        lo = to
    yield lo, n, n


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of texts (edges: where texts begin), where they begin, and their places in a row with a zero at every break."""
    kind = _kind[data]
    word = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    edge[-1] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    breaks = np.cumsum((kind == 2) | edge[:-1])  # the edge at a text's first byte counts with that byte
    apart = np.zeros(len(starts), np.int64)
    if len(starts):
        apart[1:] = breaks[starts[1:]] > breaks[ends[:-1] - 1]
    return strings(_LOWER[data[word]], offsets), starts, np.arange(len(starts)) + np.cumsum(apart)


class _Vocabulary:
    """Words of one language that a task has met, their counts, and codes for them from 1 on."""

    def __init__(self, name: int):
        self.name, self.part, self.places = name, 0, 0
        self.codes: dict[bytes, int] = {}
        self.counts: list[np.ndarray] = []

    def add(self, words: pa.Array, at: np.ndarray, own: int) -> tuple[bytes, int]:
        """Codes of a row of words, of which the first `own` are counted; its places, and how many are the row's own."""
        local, distinct = coded(words)
        known = self.codes
        lookup = np.array([known.setdefault(w, len(known) + 1) for w in distinct.to_pylist()], np.int64)
        row = np.zeros(int(at[-1]) + 1 if len(at) else 0, "<i4")
        row[at] = lookup[local]
        self.counts.append(np.bincount(lookup[local[:own]], minlength=len(known) + 1))
        if len(self.counts) > 8:
            self.counts = [self.summed()]
        self.part += 1
        self.places += len(row)
        return row.tobytes(), int(at[own]) if own < len(at) else len(row)

    def summed(self) -> np.ndarray:
        total = np.zeros(len(self.codes) + 1, np.int64)
        for x in self.counts:
            total[: len(x)] += x
        return total

    def full(self, words: int, places: int) -> bool:
        return len(self.codes) > words or self.places > places


def coded_texts(docs: DataFrame) -> DataFrame:
    """CODED, stored: rows of codes, and the words and counts that the codes of one `vocab` stand for. docs: lang, text."""
    schema = pa.schema(
        [("vocab", pa.int64()), ("lang", pa.string()), ("part", pa.int32()), ("base", pa.int32()), ("own", pa.int32()), ("codes", pa.binary()),
         ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = iter(range(TaskContext.get().partitionId() << 32, 1 << 63))
        open_: dict[str, _Vocabulary] = {}

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            held = open_.pop(lang)
            words, counts = [w.decode() for w in held.codes], held.summed()[1:].tolist()
            for at in range(0, len(words), 1 << 14):
                yield row(held.name, lang, None, at + 1, None, None, words[at : at + (1 << 14)], counts[at : at + (1 << 14)])

        for batch in batches:
            langs, texts = pc.fill_null(rows_of(batch, "lang"), "und"), rows_of(batch, "text")
            for lang in pc.unique(langs).to_pylist():
                for part in slices(texts.filter(pc.equal(langs, lang)), SLICE):
                    long = part.n == 1
                    for lo, to, end in stretches(part.data, SLICE) if long else [(0, len(part.data), len(part.data))]:
                        words, starts, at = words_of(part.data[lo:end], np.zeros(1, np.int64) if long else part.offsets)
                        if not len(words):
                            continue
                        if lang not in open_:
                            open_[lang] = _Vocabulary(next(names))
                        held = open_[lang]
                        codes, own = held.add(words, at, int(np.searchsorted(starts, to - lo)))
                        yield row(held.name, lang, held.part, None, own, codes, None, None)
                        if held.full(VOCABULARY, PLACES):
                            yield from closed(lang)
        for lang in list(open_):
            yield from closed(lang)

    return stored(docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(encode, CODED), "phrases-coded")


def numbered(df: DataFrame, name: str, keys: list[str], tag: str, first: int = 0) -> DataFrame:
    """df stored in the order of its keys, with the place of each row in that order."""
    spark = df.sparkSession
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), tag)
    sizes = sorted((r.p, r.n) for r in rows.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    bases, at = [], first
    for p, n in sizes:
        bases.append((p, at))
        at += n
    base = F.broadcast(spark.createDataFrame(bases, "_p long, _base long"))
    place = (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return rows.join(base, F.shiftright("_at", 33) == F.col("_p")).select(place, *df.columns)


def frequent_words(coded_rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f for words of frequency `least` and more, ids from 1 on; vocab, code, id for their codes)."""
    pairs = coded_rows.where("words is not null").select("vocab", "lang", "base", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x"))
    words = pairs.select("vocab", "lang", (F.col("base") + F.col("i")).alias("code"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counted = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    known = numbered(counted, "id", ["lang", "word"], "phrases-words", 1)
    return known, words.select("vocab", "code", "lang", "word").join(known.select("id", "lang", "word"), ["lang", "word"]).select("vocab", "code", F.col("id").cast("int").alias("id"))


def id_rows(coded_rows: DataFrame, codes: DataFrame) -> DataFrame:
    """ids, own, stored: the rows of codes as ids of frequent words; other words and breaks are zeros, and places that no phrase can hold are left out."""
    spark = coded_rows.sparkSession
    n_bytes = coded_rows.agg(F.sum(F.octet_length("codes").cast("long"))).first()[0] or 0
    rows = coded_rows.where("codes is not null").select("vocab", F.lit(1).alias("kind"), F.col("part").alias("at"), F.lit(0).alias("id"), "own", "codes")
    keys = codes.select("vocab", F.lit(0).alias("kind"), F.col("code").alias("at"), "id", F.lit(None).cast("int").alias("own"), F.lit(None).cast("binary").alias("codes"))
    both = rows.unionByName(keys).repartition(partitions_for(spark, n_bytes, 32 << 20), "vocab").sortWithinPartitions("vocab", "kind", "at")

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lookup, held = None, np.zeros(1, np.int32), []
        for batch in batches:
            vocab, kind, at, ids = (rows_of(batch, c).to_numpy() for c in ("vocab", "kind", "at", "id"))
            own, codes = rows_of(batch, "own"), rows_of(batch, "codes")
            cuts = [0, *(np.flatnonzero(np.diff(vocab) | np.diff(kind)) + 1).tolist(), len(vocab)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if vocab[lo] != current:
                    current, held, lookup = vocab[lo], [], None
                if not kind[lo]:
                    held.append((at[lo:hi], ids[lo:hi]))
                    continue
                if lookup is None:
                    lookup = np.zeros(1 + max([0, *(int(x.max()) for x, _ in held)]), np.int32)
                    for x, y in held:
                        lookup[x] = y
                for i in range(lo, hi):
                    row = np.frombuffer(codes[i].as_buffer(), "<i4")
                    row = lookup[np.where(row < len(lookup), row, 0)]
                    on = np.concatenate([[False], row > 0, [False]])
                    paired = on[1:-1] & (on[:-2] | on[2:])  # a word without a frequent neighbour is in no phrase
                    row = np.where(paired, row, 0)
                    keep = paired | np.concatenate([[False], paired[:-1]])
                    n_own = int(np.count_nonzero(keep[: own[i].as_py()]))
                    if n_own:
                        yield pa.RecordBatch.from_arrays([pa.array([row[keep].astype("<i4").tobytes()], pa.binary()), pa.array([n_own], pa.int32())], ["ids", "own"])

    return stored(both.mapInArrow(translate, "ids binary, own int"), "phrases-ids")


# ------------------------------------------------------------------ candidates


def _hashes(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        ids, own = rows_of(batch, "ids"), rows_of(batch, "own").to_pylist()
        for i in range(len(ids)):
            yield np.frombuffer(ids[i].as_buffer(), "<i4"), own[i]


def _extensions(trie: Trie | None, first: int, frequent: np.ndarray | None, ids: np.ndarray, own: int) -> np.ndarray:
    """phrase << 32 | next word for every place at which a phrase of the trie is followed by a frequent word. Without a trie words are the phrases.

    frequent: bits of hashed frequent pairs of words; the phrase's last word and the next must be one.
    """
    if trie is None:
        at, phrase, last = np.flatnonzero(ids[:own]), None, 0
    else:
        for at, state in trie.advance(ids, own):
            pass
        phrase, last = trie.accept[state].astype(np.int64) + first, trie.depth - 1
    inside = at + last + 1 < len(ids)
    at = at[inside]
    after = ids[at + last + 1].astype(np.int64)
    phrase = ids[at].astype(np.int64) if phrase is None else phrase[inside]
    on = after > 0
    if frequent is not None:
        pair = _hashes(ids[at + last].astype(np.int64) << 32 | after, CELLS)
        on &= frequent[pair >> 3] >> (pair & 7).astype(np.uint8) & 1 > 0
    return phrase[on] << 32 | after[on]


def hot_cells(rows: DataFrame, shipped: list, frequent, least: int) -> np.ndarray:
    """Bits of the cells that at least `least` extensions fall into. Tasks send counts of cells, cut at 255, in rows of 2 ** CELL_ROW."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS, np.int32)
        for ids, own in _rows(batches):
            for s in shipped:
                trie, first = s.value
                np.add.at(cells, _hashes(_extensions(trie, first, frequent and frequent.value, ids, own), CELLS), 1)
        cells = np.minimum(cells, 255).astype(np.uint8).reshape(-1, 1 << CELL_ROW)
        for i in np.flatnonzero(cells.any(1)).tolist():
            places = np.flatnonzero(cells[i])
            sparse = 3 * len(places) < cells.shape[1]
            body = places.astype("<u2").tobytes() + cells[i][places].tobytes() if sparse else cells[i].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sparse]), pa.array([body], pa.binary())], ["row", "sparse", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sparse, body in zip(*(rows_of(batch, c).to_pylist() for c in ("row", "sparse", "cells")), strict=True):
                total = sums.setdefault(i, np.zeros(1 << CELL_ROW, np.int64))
                if sparse:
                    n = len(body) // 3
                    total[np.frombuffer(body, "<u2", n)] += np.frombuffer(body, np.uint8, n, 2 * n)
                else:
                    total += np.frombuffer(body, np.uint8)
        for i, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["row", "bits"])

    n = partitions_for(rows.sparkSession, 0)
    found = rows.mapInArrow(count, "row int, sparse boolean, cells binary").repartition(n, "row").mapInArrow(add, "row int, bits binary").toArrow()  # 2 ** CELLS bits in all
    bits = np.zeros((1 << CELLS - CELL_ROW, 1 << CELL_ROW - 3), np.uint8)
    for i, b in zip(found["row"].to_pylist(), found["bits"].to_pylist(), strict=True):
        bits[i] = np.frombuffer(b, np.uint8)
    return bits.reshape(-1)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def candidates(rows: DataFrame, shipped: list, frequent, hot, least: int) -> DataFrame:
    """phrase, next for the extensions that occur `least` times and more.

    Only those in hot cells are sent, with counts cut at 255 a task, many keys of a bucket (by hash) in a row.
    """
    n_parts = partitions_for(rows.sparkSession, 0)
    n_buckets = 4 * n_parts

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = hot.value
        held, room = [], 0

        def sent(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = _hashes(keys, 40) % n_buckets
            order = np.argsort(bucket, kind="stable")
            keys, n = keys[order].astype("<i8"), np.minimum(n[order], 255).astype(np.uint8)
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            own = np.flatnonzero(np.diff(cuts)).tolist()
            bodies = [[x[cuts[i] : cuts[i + 1]].tobytes() for i in own] for x in (keys, n)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[pa.array(x, pa.binary()) for x in bodies]], ["bucket", "keys", "n"])

        for ids, own in _rows(batches):
            for s in shipped:
                keys = _extensions(*s.value, frequent and frequent.value, ids, own)
                cell = _hashes(keys, CELLS)
                held.append(np.unique(keys[bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0], return_counts=True))
                room += len(held[-1][0])
                if room > HELD:
                    held, room = [_summed(held)], 0
                    if len(held[0][0]) > HELD // 2:
                        yield from sent(*held.pop())
        if held:
            yield from sent(*_summed(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for batch in batches:
            for keys, n in zip(rows_of(batch, "keys").to_pylist(), rows_of(batch, "n").to_pylist(), strict=True):
                held.append((np.frombuffer(keys, "<i8"), np.frombuffer(n, np.uint8).astype(np.int64)))
                room += len(held[-1][0])
                if room > HELD:
                    held, room = [_summed(held)], 0
        if held:
            keys, n = _summed(held)
            keys = keys[n >= least]
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array((keys & 0xFFFFFFFF).astype(np.int32))], ["phrase", "next"])

    sent_rows = rows.mapInArrow(find, "bucket int, keys binary, n binary").repartition(n_parts, "bucket")
    return sent_rows.mapInArrow(add, "phrase long, next int")


def tries_of(phrases: DataFrame) -> Iterator[tuple[Trie, int]]:
    """Tries of phrases (place and WORDS) in their order, SHARD at most each, with the first place of each."""
    n = phrases.agg(F.max("place")).first()[0]
    for first in range(0, 0 if n is None else n + 1, SHARD):
        own = phrases.where((F.col("place") >= first) & (F.col("place") < first + SHARD)).select("place", *WORDS).toArrow()  # SHARD rows
        order = np.argsort(own["place"].to_numpy())
        words = np.stack([own[w].to_numpy()[order] for w in WORDS], 1)
        yield Trie(words[:, : max(1, int((words > 0).sum(1).max(initial=1)))]), first


def counts_of(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """place, a: how often each phrase occurs. A job for each trie, which is all that its tasks hold besides a count for each phrase.

    Tasks send their counts in rows of 2 ** CELL_ROW, which are summed.
    """
    spark = rows.sparkSession
    parts = []
    for trie, first in tries_of(phrases):
        shipped = spark.sparkContext.broadcast(trie)

        def count(batches: Iterator[pa.RecordBatch], shipped=shipped, first=first) -> Iterator[pa.RecordBatch]:
            trie = shipped.value
            total = np.zeros((trie.n >> CELL_ROW) + 1 << CELL_ROW, np.int64)
            for ids, own in _rows(batches):
                for _, state in trie.advance(ids, own):
                    ended = trie.accept[state]
                    total += np.bincount(ended[ended >= 0], minlength=len(total))
            for i, part in enumerate(total.reshape(-1, 1 << CELL_ROW)):
                places = np.flatnonzero(part)
                if len(places):
                    body = places.astype("<u2").tobytes() + part[places].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([first + (i << CELL_ROW)]), pa.array([body], pa.binary())], ["base", "counts"])

        parts.append(rows.mapInArrow(count, "base long, counts binary"))
    if not parts:
        return spark.createDataFrame([], "place long, a long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for base, body in zip(rows_of(batch, "base").to_pylist(), rows_of(batch, "counts").to_pylist(), strict=True):
                n = len(body) // 10
                sums.setdefault(base, np.zeros(1 << CELL_ROW, np.int64))[np.frombuffer(body, "<u2", n)] += np.frombuffer(body, "<i8", n, 2 * n)
        for base, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found + base), pa.array(total[found])], ["place", "a"])

    return reduce(DataFrame.unionAll, parts).repartition(partitions_for(spark, 0), "base").mapInArrow(add, "place long, a long")


def frequent_phrases(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """WORDS (ids, 0 past the end), size, a: all phrases of 2 to `longest` words that occur `least` times and more.

    Level by level: a phrase is a candidate if the phrase without its last word is frequent, its last
    two words fall among hashed frequent pairs, its cell is hot, and it then occurs often enough by
    counts cut at 255 a task. No frequent phrase is missed, as each of these only bounds its
    frequency from above. All candidates' frequencies are then counted by tries.
    """
    spark = rows.sparkSession
    shipped, frequent, known, parts = [spark.sparkContext.broadcast((None, 0))], None, None, []
    for size in range(2, longest + 1):
        hot = spark.sparkContext.broadcast(hot_cells(rows, shipped, frequent, least))
        found = candidates(rows, shipped, frequent, hot, least)
        if known is None:
            named = found.select(F.col("phrase").cast("int").alias("w1"), F.col("next").alias("w2"), F.lit(0).alias("w3"), F.lit(0).alias("w4"))
        else:
            last = WORDS[size - 1]
            named = found.join(known, found["phrase"] == known["place"]).select(*[F.col("next").alias(last) if w == last else w for w in WORDS])
        known = numbered(named, "place", WORDS, "phrases-level")
        parts.append(known.drop("place"))
        if size < longest:
            if frequent is None:
                frequent = spark.sparkContext.broadcast(hashed_pairs(known))
            shipped = [spark.sparkContext.broadcast(x) for x in tries_of(known)]
            if not shipped:
                break
    phrases = numbered(reduce(DataFrame.unionAll, parts), "place", WORDS, "phrases-all")
    size = reduce(Column.__add__, [(F.col(w) > 0).cast("int") for w in WORDS]).alias("size")
    return stored(phrases.join(counts_of(rows, phrases), "place").where(F.col("a") >= least).select(*WORDS, size, "a"), "phrases-counted")


def hashed_pairs(pairs: DataFrame) -> np.ndarray:
    """Bits of the hashes of pairs (w1, w2); 2 ** CELLS of them, whatever the number of pairs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << CELLS, bool)
        for batch in batches:
            held[_hashes(rows_of(batch, "w1").to_numpy().astype(np.int64) << 32 | rows_of(batch, "w2").to_numpy().astype(np.int64), CELLS)] = True
        rows = held.reshape(-1, 1 << CELL_ROW)
        for i in np.flatnonzero(rows.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(rows[i], bitorder="little").tobytes()], pa.binary())], ["row", "bits"])

    marked = pairs.select("w1", "w2").mapInArrow(mark, "row int, bits binary").groupBy("row").agg(F.collect_list("bits").alias("bits")).toArrow()  # 2 ** CELLS bits a task at most
    out = np.zeros((1 << CELLS - CELL_ROW, 1 << CELL_ROW - 3), np.uint8)
    for i, held in zip(marked["row"].to_pylist(), marked["bits"].to_pylist(), strict=True):
        for b in held:
            out[i] |= np.frombuffer(b, np.uint8)
    return out.reshape(-1)


# ------------------------------------------------------------------ scores


def _part(first: int, n: int) -> Column:
    """The n words from word `first` (from 0) on, as one key."""
    return F.array(*[F.col(WORDS[first + i]) if i < n else F.lit(0) for i in range(LONGEST - 1)])


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases with l, r and score of the cut that scores lowest."""
    cuts = F.array(*[
        F.struct(F.lit(size).alias("size"), F.lit(k).alias("k"), F.lit(side).alias("side"), (_part(k, size - k) if side else _part(0, k)).alias("key"))
        for size in range(2, LONGEST + 1) for k in range(1, size) for side in (0, 1)
    ])
    asked = phrases.select(*WORDS, "size", "a", F.explode(cuts).alias("c")).where("c.size = size").select(*WORDS, "size", "a", "c.k", "c.side", "c.key")
    single = words.select(F.array(F.col("id").cast("int"), F.lit(0), F.lit(0)).alias("key"), "f")
    known = single.unionAll(phrases.where(F.col("size") < LONGEST).select(F.array("w1", "w2", "w3").alias("key"), F.col("a").alias("f")))
    sides = asked.join(known, "key").groupBy(*WORDS, "size", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return sides.groupBy(*WORDS, "size", "a").agg(best).select(*WORDS, "size", "a", "b.l", "b.r", "b.score")


def without_parts(phrases: DataFrame, all_phrases: DataFrame, share: int) -> DataFrame:
    """phrases but those inside a longer one of all_phrases that has `share` of 100 of their frequency."""
    subs = F.array(*[
        F.struct(F.lit(size).alias("size"), _part(i, n).alias("key")) for size in range(3, LONGEST + 1) for n in range(2, size) for i in range(size - n + 1)
    ])
    held = all_phrases.where("size > 2").select("a", "size", F.explode(subs).alias("s")).where("s.size = size")
    most = held.groupBy(F.col("s.key").alias("key")).agg(F.max("a").alias("longer"))
    keyed = phrases.withColumn("key", F.when(F.col("size") < LONGEST, F.array("w1", "w2", "w3")))
    dropped = F.coalesce(F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(share).cast("decimal(20,0)") * F.col("a"), F.lit(False))
    return keyed.join(most, "key", "left").where(~dropped).drop("key", "longer")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to 4 words of each language.

    docs: lang, text, every row counted, repeated ones too; doc_id and extra columns aren't looked at.
    A null lang is `und`, and one language with what is called so; null and empty texts have no words.
    Very long texts are cut into stretches whose phrases meet across the cuts. Phrases that tie in
    score and frequency are ordered by their bytes. Empty tables, and those without frequent
    phrases, give no rows.
    """
    rows = coded_texts(docs)
    words, codes = frequent_words(rows, least)
    phrases = frequent_phrases(id_rows(rows, codes), least, LONGEST)
    left = without_parts(scored(phrases, words), phrases, share)
    totals = rows.where("counts is not null").groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    named = left.join(words.select(F.col("id").alias("w1"), "lang"), "w1")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    few = named.withColumn("tied", F.rank().over(by)).where(F.col("tied") <= top).drop("tied")  # with all that tie with the last
    ids = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(w).alias("id")) for i, w in enumerate(WORDS)])).alias("x")
    spelled = few.select(*WORDS, "lang", "a", "l", "r", "score", ids).select(*WORDS, "lang", "a", "l", "r", "score", "x.i", "x.id").join(words.select("id", "word"), "id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x.word)
    phrase = spelled.groupBy(*WORDS, "lang", "a", "l", "r", "score").agg(F.array_join(parts, " ").alias("phrase"))
    placed = phrase.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents))
  WHERE len(words) > 0
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, w, count(*)::BIGINT AS a FROM (
    SELECT lang, unnest([words[i:i + k - 1] FOR i IN range(1, len(words) - k + 2)]) AS w FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k)
  GROUP BY lang, w HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT p.lang, p.w, p.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * p.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM grams WHERE len(w) > 1) p
  JOIN grams l ON l.lang = p.lang AND l.w = p.w[1:k] JOIN grams r ON r.lang = p.lang AND r.w = p.w[k + 1:]
), best AS (
  SELECT lang, w, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS b FROM cuts) WHERE b = 1
), held AS (
  SELECT lang, s, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS s FROM grams, (SELECT unnest([2, 3]) AS k) WHERE len(w) > k)
  GROUP BY lang, s
), kept AS (
  SELECT b.*, array_to_string(w, ' ') AS phrase FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.s = b.w
  WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < {SHARE}::HUGEINT * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""

QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": COLLOCATIONS_SQL}
