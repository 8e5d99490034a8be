"""N-grams of texts that a registry may hold: hashed in arrays, tested against a Bloom filter, and only hits become rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FIRST_PERSON, LEAK_GRAM

#: Bits of a filter for each gram, and at most: 16 MiB, 4,194,304 grams. Two bits are set a gram, so one other gram in 250 passes.
BITS_A_GRAM, MOST_BITS, FEWEST_BITS = 32, 1 << 27, 1 << 16
#: Bytes of text that are in arrays at once; a word at the end is never cut.
SLICE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
#: Odd, so that powers have inverses modulo 2^64.
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PEOPLE = {a.encode(): b.encode() for a, b in FIRST_PERSON.items()}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_STEP)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_BASE)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words wherever they stand: its part of a running sum, moved to the first place."""
    up, down = _tables(1 << max(len(data), 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


@functools.cache
def _people() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the first person in order, and those of the words that stand for them."""

    def of(words) -> np.ndarray:
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        return word_hashes(data, *spans(data))

    was, now = of(_PEOPLE.keys()), of(_PEOPLE.values())
    order = np.argsort(was)
    return was[order], now[order]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[a-z0-9]+`."""
    word = _WORD[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    return edges[::2], edges[1::2]


def slices(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, start of its first word, end of its last word) of a long array of bytes, slice by slice; slices share size - 1 words."""
    begin, reach, total = 0, 0, len(data)
    while reach < total:
        reach = min(reach + SLICE, total)
        while reach < total and _WORD[data[reach]]:
            ahead = np.flatnonzero(~_WORD[data[reach : reach + SLICE]])
            reach = min(reach + (int(ahead[0]) if len(ahead) else SLICE), total)
        part = data[begin:reach]
        starts, ends = spans(part)
        n = len(starts) - size + 1
        if n > 0:
            words = word_hashes(part, starts, ends)
            was, now = _people()
            place = np.minimum(np.searchsorted(was, words), len(was) - 1)
            words = np.where(was[place] == words, now[place], words)
            step, hashes = np.uint64(_STEP), np.zeros(n, np.uint64)
            for k in range(size):
                hashes = hashes * step + words[k : k + n]
            yield _mixed(hashes), starts[:n] + begin, ends[size - 1 :] + begin
        if len(starts) >= size:
            begin += int(starts[n])
        elif not len(starts):
            begin = reach


class Filter:
    """A Bloom filter of 64-bit hashes: two bits each, by their low and their high half."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _joined(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), offsets, np.array(owners)


def grams(texts: DataFrame, key: str | None, folded: str, size: int = LEAK_GRAM, held: Broadcast | None = None,
          views: Callable[[str], Iterable[bytes]] | None = None, spell: bool = True) -> DataFrame:
    """key, gram, h: the grams of each normalised text, once for each slice of it; with a filter only those that it may hold.

    With `views` the column holds texts as they are written, and the grams are those of each text's views, in lower case.
    Without `spell` the column gram is left out.

    Without a key the column is left out. Null texts and those of fewer words have none. Grams never
    reach over two rows. A gram is `word_grams`' string, h its hash.
    """
    text = F.col(folded) if views else F.encode(F.concat(F.lower(F.col(folded)), F.lit("\n")), "UTF-8")
    rows = texts.where(F.col(folded).isNotNull()).select(*([key] if key else []), text.alias("_text"))

    def arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Bytes, offsets of what stands in them, and the row of each, if several may have one."""
        if not views:
            column = column.cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if len(column) and offsets[0] < offsets[-1]:
                yield np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], None
            return
        parts, owners, room = [], [], 0
        for i in range(len(column)):
            for view in views(column[i].as_py()):
                parts.append(view)
                owners.append(i)
                room += len(view) + 1
                if room > SLICE:
                    yield _joined(parts, owners)
                    parts, owners, room = [], [], 0
        if parts:
            yield _joined(parts, owners)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, owner in arrays(batch.column("_text")):
                yield from found(batch, data, offsets, owner)

    def found(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, owner: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for hashes, first, last in slices(data, size):
            row = np.searchsorted(offsets, first, "right") - 1
            wanted = row == np.searchsorted(offsets, last, "right") - 1
            if held is not None:
                wanted &= held.value.may_hold(hashes)
            if owner is not None:
                row = owner[row]
            at = np.flatnonzero(wanted)
            _, once = np.unique(np.stack([row[at].astype(np.uint64), hashes[at]]), axis=1, return_index=True)
            at = at[once]
            strings = []
            for a, b in zip(first[at], last[at], strict=True) if spell else ():
                part = data[a:b]
                words = (part[s:e].tobytes() for s, e in zip(*spans(part), strict=True))
                strings.append(b" ".join(_PEOPLE.get(w, w) for w in words).decode())
            columns = ({"gram": pa.array(strings, pa.string())} if spell else {}) | {"h": pa.array(hashes[at].view(np.int64))}
            if key:
                columns = {key: batch.column(key).take(pa.array(row[at]))} | columns
            yield pa.RecordBatch.from_pydict(columns)

    schema = rows.drop("_text").schema
    return rows.mapInArrow(cut, (schema.add("gram", "string") if spell else schema).add("h", "long"))


def filter_of(registry: DataFrame) -> Filter | None:
    """The filter of a registry's hashes (h), its words joined from all tasks; None for more grams than MOST_BITS has room for."""
    hashes = registry.select("h").distinct()
    n = hashes.limit(MOST_BITS // BITS_A_GRAM + 1).count()
    if n > MOST_BITS // BITS_A_GRAM:
        return None
    size = max(1 << (max(n, 1) * BITS_A_GRAM - 1).bit_length(), FEWEST_BITS)
    low = F.lit(size - 1).cast("long")
    bit = F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low))).alias("bit")
    # Spark shifts an int by an int column in SQL only.
    word = hashes.select(bit).selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63 AS INT)) AS bits").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = word.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(bits)
