"""Runs of windows that share a minimiser: how equal windows of any two documents meet.

A window is L units (words or bytes) of one document. Its minimiser is the k-gram in it with
the least hash, leftmost on ties. Equal windows have the same one at the same place, so rows
keyed by the minimiser's hash bring all occurrences of a window together, while a run of
windows around one k-gram costs one row instead of one for each window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import LONG_ROW, Slice, eights, grams, mix, sequence_hashes, string_hashes

PLACE_BITS = 24
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


@dataclass
class Units:
    """The units of a slice: first unit of each document (n + 1), hashes of k-grams; of words also their hashes and byte bounds."""

    data: np.ndarray
    offsets: np.ndarray
    grams: np.ndarray
    hashes: np.ndarray | None = None
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def bytes_of(self, lo: int, hi: int) -> tuple[int, int]:
        """Byte bounds of the units [lo, hi)."""
        if self.starts is None:
            return lo, hi
        return int(self.starts[lo]), int(self.ends[hi - 1])

    def span_hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the units [lo, hi) for each pair."""
        if self.hashes is None:
            return string_hashes(self.data, lo, hi)
        return sequence_hashes(self.hashes, lo, hi)


def word_units(part: Slice, k: int) -> Units:
    starts, ends, offsets = part.words()
    hashes = string_hashes(part.data, starts, ends)
    return Units(part.data, offsets, grams(hashes, k), hashes, starts, ends)


def byte_units(part: Slice, k: int) -> Units:
    """k is 8 at least; the last eight bytes of a gram may overlap those before."""
    count = max(0, len(part.data) - k + 1)
    at = eights(part.data)
    out = np.full(count, k, np.uint64)
    for place in [*range(0, k - 8, 8), k - 8]:
        out = (out ^ at[place : place + count]) * np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(32)
    return Units(part.data, part.offsets, mix(out))


def _least_places(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each start i, the place of the least of hashes[i : i + w] by its upper 40 bits, leftmost on ties."""
    n = len(hashes)
    upper = hashes >> np.uint64(PLACE_BITS)
    if n <= int(_PLACE):
        best = (upper << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        step = 1
        while step * 2 <= w:
            best = np.minimum(best[: len(best) - step], best[step:])
            step *= 2
        if step < w:
            best = np.minimum(best[: n - w + 1], best[w - step : w - step + n - w + 1])
        return (best & _PLACE).astype(np.int64)
    value, place, step = upper, np.arange(n), 1  # too long for packed places

    def lesser(a, pa, b, pb):
        right = b < a
        return np.where(right, b, a), np.where(right, pb, pa)

    while step * 2 <= w:
        m = len(value) - step
        value, place = lesser(value[:m], place[:m], value[step:], place[step:])
        step *= 2
    if step < w:
        m = n - w + 1
        value, place = lesser(value[:m], place[:m], value[w - step : w - step + m], place[w - step : w - step + m])
    return place


@dataclass
class Runs:
    """Runs of windows: document (of the slice), first window's first unit, number of windows, key of the minimiser."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray


def runs_of(units: Units, length: int, k: int) -> Runs:
    """All runs of a slice; documents with fewer units than a window have none."""
    none = np.zeros(0, np.int64)
    w = length - k + 1
    if len(units.grams) < w:
        return Runs(none, none, none, np.zeros(0, np.uint64))
    places = _least_places(units.grams, w)
    sizes = np.maximum(0, np.diff(units.offsets) - length + 1)  # windows of each document
    total = int(sizes.sum())
    if not total:
        return Runs(none, none, none, np.zeros(0, np.uint64))
    holding = np.flatnonzero(sizes)
    sizes, firsts = sizes[holding], units.offsets[holding]
    began = np.cumsum(sizes) - sizes
    at = np.arange(total) + np.repeat(firsts - began, sizes)
    place = places[at]
    new = np.ones(total, bool)
    new[1:] = place[1:] != place[:-1]
    new[began] = True
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, total))
    doc = holding[np.searchsorted(began, heads, "right") - 1]
    return Runs(doc, at[heads], counts, units.grams[place[heads]])


def run_hashes(units: Units, runs: Runs, length: int) -> np.ndarray:
    """A 64-bit hash of all units of each run; equal for equal runs."""
    ends = runs.start + runs.count - 1 + length
    return mix(units.span_hashes(runs.start, ends) ^ (runs.key + runs.count.astype(np.uint64)))


def pieces(part: Slice, by_words: bool, length: int) -> Iterator[tuple[Slice, int]]:
    """A slice, or a long row cut so that each window lies in one piece; with the first unit of each."""
    n = len(part.data)
    if part.n != 1 or n <= LONG_ROW:
        yield part, 0
        return
    if by_words:
        starts, ends, _ = part.words()
        step = LONG_ROW // 8
        cuts = [(at, int(starts[at]), int(ends[min(at + step + length - 1, len(starts)) - 1])) for at in range(0, len(starts), step)]
    else:
        cuts = [(at, at, min(n, at + LONG_ROW + length - 1)) for at in range(0, n, LONG_ROW)]
    for first, lo, hi in cuts:
        yield Slice(part.data[lo:hi], np.array([0, hi - lo]), part.first), first
