"""Many fixed strings at once: an automaton over a bounded registry, one pass a text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings and bytes of a registry that an automaton is built of, in each worker process; some 100 bytes of memory a byte at worst.
MOST_STRINGS, MOST_BYTES = 200_000, 4 << 20

_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(key: str, strings: Broadcast) -> ahocorasick.Automaton:
    """The automaton of these strings, built once for the life of a worker process; one registry is kept at a time."""
    if key not in _BUILT:
        built = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for s in strings.value:
            built.add_word(s)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[key] = built
    return _BUILT[key]


def bounded(registry: DataFrame, name: str) -> list[str] | None:
    """The registry's distinct strings in order, null and empty ones left out; None if they pass the bounds."""
    wanted = registry.select(name).where(F.length(name) > 0).distinct()
    n, n_bytes = wanted.limit(MOST_STRINGS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(name))).first()
    if n > MOST_STRINGS or (n_bytes or 0) > MOST_BYTES:
        return None
    return sorted(r[0] for r in wanted.collect())


def _as_it_is(text: str) -> tuple[str]:
    return (text,)


def holding_any(texts: DataFrame, strings: list[str], key: str, text: str, views: Callable[[str], Iterable[str]] = _as_it_is) -> DataFrame:
    """The keys of rows whose text, or one of its views, contains one of the strings, a row for each such text. Null texts contain none.

    The texts are read once and nothing is exploded; a text is left at its first hit.
    """
    rows = texts.select(key, text).where(F.col(text).isNotNull())
    if not strings:
        return rows.select(key).limit(0)
    shared = texts.sparkSession.sparkContext.broadcast(strings)
    digest = hashlib.sha256("\0".join(strings).encode()).hexdigest()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(digest, shared)
        for batch in batches:
            hit = [any(next(machine.iter(v), None) is not None for v in views(t)) for t in batch.column(text).to_pylist()]
            yield batch.select([key]).filter(pa.array(hit, pa.bool_()))

    return rows.mapInArrow(search, rows.select(key).schema)
