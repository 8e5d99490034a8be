"""Which keys occur in more than one place of a corpus, found without a row for each key.

Tasks send sorted key blobs to ranges of the key's hash; a range finds the keys that occur
again and sends each bucket of documents the list of its own. Then every bucket's documents
are streamed past that list. Nothing is broadcast and nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Slice, partitions_for, rows_of, size_of, slices

#: Entries that a task gathers before it sends them.
FLUSH = 1 << 20


class Layout:
    """An entry is, from the top: hash bits, bucket bits, and a bit for `occurs again here`. The range's own bits aren't sent.

    Buckets are `n_parts` times a small number. Entries of more than 2^16 buckets are wider and
    have fewer hash bits, so past some TB more keys pass that occur once; none is lost.
    """

    def __init__(self, n_parts: int, n_keys: float):
        self.n_parts = n_parts
        self.buckets = n_parts * max(1, min(8, (1 << 16) // n_parts))
        self.bucket_bits = max(6, (self.buckets - 1).bit_length())
        # at most 16, as an entry with its range's bits is a uint64; past that ranges get longer
        self.range_bits = min(16, max(6, int(n_keys / (1 << 20)).bit_length()))
        self.ranges = 1 << self.range_bits
        self.width = 6 if self.bucket_bits <= 16 else 8
        self.hash_bits = min(63 - self.bucket_bits, 8 * self.width - 1 - self.bucket_bits + self.range_bits)

    def short(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.hash_bits)


def _folded(entries: np.ndarray) -> np.ndarray:
    """Sorted entries, those of one hash and bucket joined into one that is marked as occurring again."""
    entries = np.sort(entries)
    body = entries >> np.uint64(1)
    new = np.ones(len(body), bool)
    new[1:] = body[1:] != body[:-1]
    heads = np.flatnonzero(new)
    again = np.diff(np.append(heads, len(body))) > 1
    return entries[heads] | again.astype(np.uint64)


def _packed(entries: np.ndarray, width: int) -> bytes:
    """The lower `width` bytes, all first bytes together, then all second ones: sorted entries compress well so."""
    return entries.view(np.uint8).reshape(-1, 8)[:, width - 1 :: -1].T.tobytes()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, width - 1 :: -1] = planes.T
    return out.view(np.uint64).reshape(-1)


def member(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def with_shared_keys(
    docs: DataFrame,
    keys_of: Callable[[Slice], tuple[np.ndarray, np.ndarray]],
    emit: Callable[[Slice, pa.RecordBatch, Callable[[np.ndarray], np.ndarray]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    keys_per_byte: float,
    carried: tuple[str, ...] = (),
) -> tuple[DataFrame, int]:
    """Stream documents (rid, doc_id, text, and carried columns) through emit, which is told which keys occur in more than one place.

    keys_of gives uint64 keys and their documents (of the slice); a key given twice for one
    document counts as two places. emit gets a slice, its rows and a test of keys. A test may pass
    a key that occurs once (hash bits are cut), never fail one that occurs again. Texts travel in
    compressed blobs, one for each bucket that a batch meets. Rows lie where a table bucketed by
    rid wants them; the number of its buckets comes with the frame.
    """
    spark = docs.sparkSession
    _, n_bytes = size_of(docs)
    n_parts = partitions_for(spark, n_bytes)
    layout = Layout(n_parts, n_bytes * keys_per_byte)
    # hash() is what Spark deals rows out by, and the number of buckets a multiple of that of partitions
    bucketed = docs.withColumn("bucket", F.pmod(F.hash("rid"), F.lit(layout.buckets)).cast("int"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            entries = _folded(np.concatenate(gathered))
            rest = np.uint64(layout.hash_bits + layout.bucket_bits + 1 - layout.range_bits)
            ranges = (entries >> rest).astype(np.int64)
            entries &= (np.uint64(1) << rest) - np.uint64(1)
            bounds = np.searchsorted(ranges, np.arange(layout.ranges + 1))
            full = np.flatnonzero(np.diff(bounds))
            blobs = [_packed(np.ascontiguousarray(entries[bounds[i] : bounds[i + 1]]), layout.width) for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["range", "blob"])

        for batch in batches:
            buckets = rows_of(batch, "bucket").to_numpy()
            for part in slices(rows_of(batch, "text")):
                keys, doc = keys_of(part)
                own = buckets[part.first + doc].astype(np.uint64)
                entries = (layout.short(keys) << np.uint64(layout.bucket_bits)) | own
                gathered.append(entries << np.uint64(1))
                held += len(keys)
                if held >= FLUSH:
                    yield flushed()
                    gathered, held = [], 0
        if held:
            yield flushed()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_range: dict[int, list[np.ndarray]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            for range_, blob in zip(rows_of(batch, "range").to_pylist(), rows_of(batch, "blob"), strict=True):
                mine = by_range.setdefault(range_, [])
                mine.append(_unpacked(blob.as_py(), layout.width))
                held[range_] = held.get(range_, 0) + len(mine[-1])
                if held[range_] > FLUSH:
                    mine[:] = [_folded(np.concatenate(mine))]
                    held[range_] = 0
        for range_, mine in by_range.items():
            entries = _folded(np.concatenate(mine))
            hashes = entries >> np.uint64(layout.bucket_bits + 1)
            new = np.ones(len(entries), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(entries)))
            again = (sizes > 1) | (np.bitwise_or.reduceat(entries, heads) & np.uint64(1)).astype(bool)
            keep = np.repeat(again, sizes)
            hashes, buckets = hashes[keep], (entries[keep] >> np.uint64(1)) & np.uint64((1 << layout.bucket_bits) - 1)
            order = np.argsort(buckets, kind="stable")
            hashes, buckets = hashes[order], buckets[order]
            hashes |= np.uint64(range_) << np.uint64(layout.hash_bits - layout.range_bits)
            bounds = np.searchsorted(buckets, np.arange(layout.buckets + 1))
            full = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([hashes[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary())],
                ["bucket", "blob"],
            )

    lists = (
        bucketed.select("bucket", "text")
        .mapInArrow(send, "range int, blob binary")
        .repartition(max(64, layout.ranges), "range")
        .mapInArrow(reduce, "bucket int, blob binary")
    )

    own = ["rid", "doc_id", "text", *carried]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            buckets = rows_of(batch, "bucket").to_numpy()
            order = np.argsort(buckets, kind="stable")
            texts = batch.select(own)
            full, heads = np.unique(buckets[order], return_index=True)
            for bucket, lo, hi in zip(full.tolist(), heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, texts.schema, options=options) as writer:
                    writer.write_batch(texts.take(pa.array(order[lo:hi])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "blob"]
                )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, known = None, [], np.zeros(0, np.uint64)
        for batch in batches:
            for bucket, kind, blob in zip(rows_of(batch, "bucket").to_pylist(), rows_of(batch, "kind").to_pylist(), rows_of(batch, "blob"), strict=True):
                if bucket != current:
                    current, gathered, known = bucket, [], np.zeros(0, np.uint64)
                if kind == 0:
                    gathered.append(np.frombuffer(blob.as_py(), np.uint64))
                    continue
                if gathered:
                    known, gathered = np.sort(np.concatenate([known, *gathered])), []
                test = lambda keys, known=known: member(known, layout.short(keys))
                for rows in pa.ipc.open_stream(blob.as_buffer()):
                    for part in slices(rows_of(rows, "text")):
                        yield from emit(part, rows.slice(part.first, part.n), test)

    rows = lists.select("bucket", F.lit(0).alias("kind"), "blob").unionByName(
        bucketed.mapInArrow(pack, "bucket int, blob binary").select("bucket", F.lit(1).alias("kind"), "blob")
    )
    placed = rows.repartitionById(n_parts, F.pmod("bucket", F.lit(n_parts))).sortWithinPartitions("bucket", "kind")
    return placed.mapInArrow(stream, schema), n_parts
