"""Removal of repeated windows from whole documents: words through an FM-index, bytes through a suffix order.

Both work alike. Runs of windows with one minimiser (windows.py) are kept where the minimiser
occurs in several places (shared_keys.py). Equal runs are counted as one. Where one minimiser has
different runs, one document sends each run's units to the minimiser's shard, where an index of all
runs of the shard tells which windows repeat. The finding goes back to every occurrence by the run's hash, and the removed
ranges to the documents. Minimisers with too many different runs for a shard are not searched in
one: their windows meet by hash, on Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Slice, discard, eights, free_shuffles, rows_of, slices, stored, stored_by, table
from .shared_keys import with_shared_keys
from .suffixes import FmIndex, suffix_ranks
from .windows import Units, byte_units, pieces, run_hashes, runs_of, word_units

NO_DOC = 2**63 - 1
RUN_SCHEMA = (
    "rid long, doc_id long, text string, n_units long, sha256 string, "
    "starts array<int>, counts array<int>, runs array<long>, keys array<long>"
)
BODIES = pa.schema([("run", pa.int64()), ("n", pa.int64()), ("least_doc", pa.int64()), ("body", pa.binary())])
FOUND_SCHEMA = "run long, ranges array<struct<lo:int,hi:int,least:long>>"
#: Bytes of distinct runs in a shard, about; runs that a task gathers before it sends them.
SHARD, GATHERED = 1 << 20, 100_000
#: Different runs of one minimiser past which they are not searched in one shard, as they would fill two.
HOT = SHARD // 32
#: Runs that hold one window past which its total is broadcast to them, at least.
HEAVY = 4096


@dataclass(frozen=True)
class Plan:
    """length: units of a window; k: units of a minimiser; units: how to read them; within: repeats inside one document count."""

    length: int
    k: int
    units: Callable[[Slice, int], Units]
    within: bool
    keys_per_byte: float

    @property
    def by_words(self) -> bool:
        return self.units is word_units


WORDS = Plan(35, 12, word_units, True, 1 / 50)
BYTES = Plan(50, 20, byte_units, False, 1 / 15)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _digest(data: bytes, by_words: bool) -> str:
    return hashlib.sha256(b" ".join(data.split()) if by_words else data).hexdigest()


def _runs(docs: DataFrame, plan: Plan, carried: tuple[str, ...]) -> tuple[DataFrame, int]:
    """A row for each document: its text and digest, and the runs whose minimiser occurs in several places."""

    def keys_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
        keys, docs_ = [], []
        for piece, _ in pieces(part, plan.by_words, plan.length):
            runs = runs_of(plan.units(piece, plan.k), plan.length, plan.k)
            keys.append(runs.key)
            docs_.append(runs.doc)
        key, doc = np.concatenate(keys), np.concatenate(docs_)
        if not plan.within and len(key):
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
        return key, doc

    def emit(part: Slice, rows: pa.RecordBatch, shared: Callable) -> Iterator[pa.RecordBatch]:
        found, sizes = [], np.zeros(part.n, np.int64)
        for piece, first in pieces(part, plan.by_words, plan.length):
            units = plan.units(piece, plan.k)
            runs = runs_of(units, plan.length, plan.k)
            on = shared(runs.key)
            runs.doc, runs.start, runs.count, runs.key = runs.doc[on], runs.start[on], runs.count[on], runs.key[on]
            hashes = run_hashes(units, runs, plan.length)
            found.append((runs.doc, runs.start - units.offsets[runs.doc] + first, runs.count, hashes, runs.key))
            sizes = np.maximum(sizes, np.diff(units.offsets) + first)
        doc, start, count, hashes, key = (np.concatenate(x) for x in zip(*found, strict=True))
        bounds = np.searchsorted(doc, np.arange(part.n + 1))
        data, offsets = part.data.tobytes(), part.offsets
        texts = [data[offsets[i] : offsets[i + 1]] for i in range(part.n)]
        yield pa.RecordBatch.from_arrays(
            [
                rows_of(rows, "rid"),
                rows_of(rows, "doc_id"),
                pa.array([x.decode() if bounds[i + 1] > bounds[i] or carried else None for i, x in enumerate(texts)], pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array([_digest(x, plan.by_words) for x in texts], pa.string()),
                _lists(start, bounds, pa.int32()),
                _lists(count, bounds, pa.int32()),
                _lists(hashes.view(np.int64), bounds, pa.int64()),
                _lists(key.view(np.int64), bounds, pa.int64()),
                *[rows_of(rows, c) for c in carried],
            ],
            schema.names,
        )

    schema = StructType(StructType.fromDDL(RUN_SCHEMA).fields + [docs.schema[c] for c in carried])
    return with_shared_keys(docs, keys_of, emit, schema, plan.keys_per_byte, carried)


#: Ranges of windows: index of the run, first window, window after the last, least doc_id.
Ranges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _ranges(owner: np.ndarray, window: np.ndarray, least: np.ndarray) -> Ranges:
    """Joined ranges of windows, which come by run and number, with one value."""
    new = np.ones(len(window), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(window))[: len(heads)] - 1
    return owner[heads], window[heads], window[tails] + 1, least[heads]


def _found(runs: pa.Array, ranges: Ranges) -> pa.RecordBatch:
    """A row for each run that has ranges."""
    owner, lo, hi, least = ranges
    own, heads = np.unique(owner, return_index=True)
    structs = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(least, pa.int64())], ["lo", "hi", "least"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(owner)), pa.int32()), structs)
    return pa.RecordBatch.from_arrays([runs.take(pa.array(own)), lists], ["run", "ranges"])


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and number of every window."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _laid_out(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined sequences with a 0 before, between and after them; their first places."""
    out = np.zeros(len(symbols) + len(sizes) + 1, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = symbols
    return out, np.cumsum(sizes + 1) - sizes


def search_words(bodies: pa.Array, counts: np.ndarray, _: np.ndarray, length: int) -> Ranges:
    """Windows of each run that occur twice or more in the shard.

    The index holds each run, those that occur again twice. Every window of every run is streamed
    through it, and repeats if its end's matching statistic for two occurrences reaches the
    window's length.
    """
    vocabulary: dict[bytes, int] = {}
    tokens = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in body.split()]) for body in bodies.to_pylist()]
    twice = tokens + [x for x, n in zip(tokens, counts.tolist(), strict=True) if n > 1]
    text, places = _laid_out(np.concatenate(twice), np.array([len(x) for x in twice]))
    owner, window = _windows(np.array([len(x) - length + 1 for x in tokens]))
    on = FmIndex(text, length).statistics(places[owner] + window + length, text, length) >= length
    return _ranges(owner[on], window[on], np.zeros(int(on.sum()), np.int64))


def search_bytes(bodies: pa.Array, counts: np.ndarray, least_doc: np.ndarray, length: int) -> Ranges:
    """For each window of each run that occurs again the least doc_id that any equal window of the shard has.

    Neighbours in the suffix order are compared, so equal windows make a group.
    """
    data, sizes = np.frombuffer(b"".join(bodies.to_pylist()), np.uint8), pc.binary_length(bodies).to_numpy()
    text, places = _laid_out(data.astype(np.int64) + 1, sizes)
    owner, window = _windows(sizes - length + 1)
    at = places[owner] + window
    order = np.argsort(suffix_ranks(text + 1, length)[at])
    eight, place = eights((text - 1).astype(np.uint8)), at[order]
    same = np.ones(len(place) - 1, bool)
    for shift in [*range(0, length - 7, 8), length - 8]:
        part = eight[place + shift]
        same &= part[1:] == part[:-1]
    heads = np.flatnonzero(np.append(True, ~same))
    sizes_of_groups = np.diff(np.append(heads, len(order)))
    own = owner[order]
    groups = np.minimum.reduceat(least_doc[own], heads)
    again = np.add.reduceat(counts[own], heads) > 1
    least, repeated = np.zeros(len(owner), np.int64), np.zeros(len(owner), bool)
    least[order], repeated[order] = np.repeat(groups, sizes_of_groups), np.repeat(again, sizes_of_groups)
    return _ranges(owner[repeated], window[repeated], least[repeated])


def _by_window(bodies: DataFrame, plan: Plan) -> DataFrame:
    """(run, ranges) of every run in which some window is repeated, with no group by minimiser.

    Windows meet by their 64-bit hash with partial sums. A window that very many runs hold gets
    its total by a broadcast, of at most 20,000 windows or so.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _unpacked(batches):
            for part in slices(rows_of(rows, "body")):
                units = plan.units(part, plan.k)
                sizes = np.diff(units.offsets) - plan.length + 1
                bounds = np.append(0, np.cumsum(sizes))
                at = np.arange(bounds[-1]) + np.repeat(units.offsets[:-1] - bounds[:-1], sizes)
                hashes = units.span_hashes(at, at + plan.length)
                own = rows.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays(
                    [*[rows_of(own, c) for c in ("run", "n", "least_doc")], _lists(hashes.view(np.int64), bounds, pa.int64())],
                    ["run", "n", "least_doc", "windows"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = rows_of(batch, "found")
            owner = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy())
            structs = column.flatten()
            yield _found(rows_of(batch, "run"), _ranges(owner, structs.field("place").to_numpy(), structs.field("least").to_numpy()))

    rows = stored(bodies.mapInArrow(windows, "run long, n long, least_doc long, windows array<long>"), "hot-runs")
    each = rows.select("run", "n", "least_doc", F.posexplode("windows").alias("place", "window"))
    totals = each.groupBy("window").agg(
        F.sum("n").alias("n"), F.min("least_doc").alias("least"), F.count(F.lit(1)).alias("held")
    ).where("n > 1")
    totals = stored(totals, "repeated-windows")
    limit = max(HEAVY, (totals.agg(F.sum("held")).first()[0] or 0) // 20_000)
    heavy = F.broadcast(totals.where(F.col("held") > limit).select("window", "least"))
    light = totals.where(F.col("held") <= limit).select("window", "least")
    each = each.select("run", "place", "window")
    found = each.join(heavy, "window").unionByName(each.join(heavy, "window", "left_anti").join(light, "window"))
    return (
        found.groupBy("run")
        .agg(F.sort_array(F.collect_list(F.struct("place", "least"))).alias("found"))
        .mapInArrow(joined, FOUND_SCHEMA)
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in rows_of(batch, "blob"):
            yield from pa.ipc.open_stream(blob.as_buffer())


def _bodies(runs: DataFrame, facts: DataFrame, plan: Plan, n_shards: int) -> DataFrame:
    """(shard, blob): the units of each distinct run, cut from the document that holds it for all, by the shard of its minimiser."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in ("shard", *BODIES.names)}
        held, last = 0, None
        for batch in batches:
            columns = [rows_of(batch, c) for c in ("rid", "text", "starts", "counts", "runs", "wanted")]
            for rid, text, starts, counts, own, wanted in zip(*columns, strict=True):
                if rid == last:  # equal rows
                    continue
                last = rid
                data = np.frombuffer(text.as_buffer(), np.uint8)
                run = wanted.values.field("run").to_numpy()
                mine = own.values.to_numpy()
                order = np.argsort(mine, kind="stable")
                at = order[np.searchsorted(mine[order], run)]
                lo = starts.values.to_numpy()[at].astype(np.int64)
                hi = lo + counts.values.to_numpy()[at] + plan.length - 1
                if plan.by_words:
                    first, end, _ = Slice(data, np.array([0, len(data)]), 0).words()
                    lo, hi = first[lo], end[hi - 1]
                for c in ("shard", "run", "n", "least_doc"):
                    out[c].append(wanted.values.field(c).to_numpy())
                out["body"] += [data[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                held += len(lo)
                if held > GATHERED:
                    yield packed(out)
                    out, held = {c: [] for c in out}, 0
        if held:
            yield packed(out)

    def packed(out: dict[str, list]) -> pa.RecordBatch:
        shard = np.concatenate(out["shard"])
        order = np.argsort(shard, kind="stable")
        columns = [pa.array(np.concatenate(out[c])) for c in BODIES.names[:-1]]
        rows = pa.RecordBatch.from_arrays([*columns, pa.array(out["body"], pa.binary())], schema=BODIES).take(pa.array(order))
        full, heads = np.unique(shard[order], return_index=True)
        blobs = []
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, BODIES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(rows.slice(lo, hi - lo))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int").alias("shard")
    wanted = facts.groupBy("rid").agg(F.collect_list(F.struct(shard, "run", "n", "least_doc")).alias("wanted"))
    return (
        runs.select("rid", "text", "starts", "counts", "runs")
        .join(wanted, "rid")
        .mapInArrow(cut, "shard int, blob binary")
    )


def _searched(runs: DataFrame, plan: Plan, search: Callable, n_parts: int) -> DataFrame:
    """(run, ranges) of every run in which some window is repeated."""
    spark = runs.sparkSession
    met = runs.select("rid", F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), F.explode(F.arrays_zip("counts", "runs", "keys")).alias("x"))
    facts = stored_by(
        met.groupBy(F.col("x.keys").alias("key"), F.col("x.runs").alias("run")).agg(
            F.count(F.lit(1)).alias("n"), F.min("doc").alias("least_doc"), F.min("rid").alias("rid"), F.min("x.counts").alias("windows")
        ),
        "key", n_parts, "distinct-runs",
    )
    free_shuffles(spark)
    variants = facts.groupBy("key").agg(F.count(F.lit(1)).alias("variants"))
    any_hot = not variants.where(F.col("variants") > HOT).isEmpty()
    facts_of = facts.join(variants, "key")
    n_bytes = (8 if plan.by_words else 1) * (
        facts_of.where("variants > 1").agg(F.sum(F.col("windows").cast("long") + plan.length - 1)).first()[0] or 0
    )
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // SHARD) + 1)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for number, rows in zip(rows_of(batch, "shard").to_pylist(), _unpacked([batch]), strict=True):
                by_shard.setdefault(number, []).append(rows)
        for mine in by_shard.values():
            rows = pa.Table.from_batches(mine).combine_chunks()
            run, body = (rows[c].chunk(0) for c in ("run", "body"))
            yield _found(run, search(body, rows["n"].to_numpy(), rows["least_doc"].to_numpy(), plan.length))

    # a minimiser's only run: none of its windows is in another run, so they repeat as the run does
    alone = facts_of.where("variants = 1 and n > 1").select(
        "run", F.array(F.struct(F.lit(0).alias("lo"), F.col("windows").cast("int").alias("hi"), F.col("least_doc").alias("least"))).alias("ranges")
    )
    few = _bodies(runs, facts_of.where((F.col("variants") > 1) & (F.col("variants") <= HOT)), plan, n_shards)
    found = alone.unionByName(few.repartitionById(n_shards, "shard").mapInArrow(shard, FOUND_SCHEMA))
    if any_hot:
        found = found.unionByName(_by_window(_bodies(runs, facts_of.where(F.col("variants") > HOT), plan, n_shards), plan))
    found = stored(found, "repeated-runs")
    discard(facts)
    return found


def _removed(docs: DataFrame, plan: Plan, search: Callable, with_text: bool = False) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 for each input row; with_text: also kept_text, row and had_text."""
    spark = docs.sparkSession
    carried = ("row", "had_text") if with_text else ()
    identified = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), F.col("text").isNotNull().alias("had_text")][: len(carried)],
    )
    found, n_parts = _runs(identified.withColumn("rid", F.xxhash64("doc_id", "text")), plan, carried)
    runs = stored_by(found, "rid", n_parts, "runs", placed=True)
    free_shuffles(spark)
    repeated = _searched(runs, plan, search, n_parts)
    free_shuffles(spark)
    occurrences = runs.select("rid", "doc_id", F.explode(F.arrays_zip("starts", "counts", "runs")).alias("x")).select(
        "rid", "doc_id", F.col("x.starts").alias("start"), F.col("x.counts").alias("count"), F.col("x.runs").alias("run")
    )
    hits = stored(
        occurrences.join(repeated, "run")
        .select("rid", "doc_id", "start", F.explode("ranges").alias("r"))
        .where(F.lit(True) if plan.within else F.col("r.least") < F.coalesce("doc_id", F.lit(NO_DOC)))
        .select("rid", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") - 1 + plan.length).alias("hi")),
        "hits",
    )
    discard(repeated)
    free_shuffles(spark)
    results = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"
    schema = StructType(
        StructType.fromDDL(results).fields
        + [StructField("kept_text", StringType())] * with_text
        + [runs.schema[c] for c in carried]
    )

    def kept_of(text: pa.Scalar, spans: pa.Scalar) -> tuple[int, int, bytes]:
        """Units removed, spans, and what stays."""
        data = np.frombuffer(text.as_buffer(), np.uint8)
        starts, ends, _ = Slice(data, np.array([0, len(data)]), 0).words() if plan.by_words else (np.arange(len(data)), None, None)
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, spans.values.field("lo").to_numpy(), 1)
        np.add.at(cover, spans.values.field("hi").to_numpy(), -1)
        gone = np.cumsum(cover)[:-1] > 0
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        if plan.by_words:
            kept = b" ".join([data[a:b].tobytes() for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
        else:
            kept = data[~gone].tobytes()
        return int(gone.sum()), n_spans, kept

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, digests, kept_texts = [], [], rows_of(batch, "sha256").to_pylist(), []
            texts = rows_of(batch, "text")
            for i, spans in enumerate(rows_of(batch, "spans")):
                if not spans.is_valid:
                    facts = (0, 0)
                    kept_texts.append(texts[i].as_py() if with_text else None)
                else:
                    *facts, kept = kept_of(texts[i], spans)
                    digests[i] = hashlib.sha256(kept).hexdigest()
                    kept_texts.append(kept.decode("utf-8", "ignore") if with_text else None)
                removed.append(facts[0])
                n_spans.append(facts[1])
            yield pa.RecordBatch.from_arrays(
                [rows_of(batch, "doc_id"), rows_of(batch, "n_units"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
                + [pa.array(kept_texts, pa.string())] * with_text
                + [rows_of(batch, c) for c in carried],
                schema.names,
            )

    spans = hits.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    facts = runs.select("rid", "doc_id", "text", "n_units", "sha256", *carried)
    return facts.join(spans, "rid", "left").mapInArrow(apply, schema)


def remove_repeated_words(docs: DataFrame, plan: Plan = WORDS) -> DataFrame:
    """Remove every word that a window of 35 words covers whose words also start anywhere else in the corpus.

    Output, a row for each input row: doc_id, n_words, n_removed, n_spans, kept_sha256 (of the kept
    words joined by a space). Windows are judged on the input; all copies go, in one document or
    in many. An FM-index for each shard of runs gives matching statistics (suffixes.FmIndex).
    Equal runs of windows are told by 64-bit hashes, and so are the windows of minimisers with
    more than HOT different runs; others are compared word for word.

    Null and empty texts have no words and the digest of the empty string. Repeated rows count as
    occurrences of their own, so rows of 35 words and more that occur twice lose all words. Null
    doc_ids are kept. Texts are read whole, at any length; long ones in overlapping pieces. Extra
    columns are ignored; an empty table gives no rows.
    """
    return _removed(docs, plan, search_words).withColumnRenamed("n_units", "n_words")


def remove_repeated_bytes(docs: DataFrame, plan: Plan = BYTES, with_text: bool = False) -> DataFrame:
    """Remove every byte that a 50-byte string covers which also starts in a document with a smaller doc_id.

    Output, a row for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256. Strings are judged on the input and stay in the document with the least doc_id;
    repeats inside one document, or between rows with one doc_id, stay. Windows meet in shards by
    their minimiser, where the runs' suffixes are ordered by a difference cover, to the depth of a
    window (suffixes.suffix_ranks), and neighbours compared. Equal runs of windows are told by
    64-bit hashes, and so are the windows of minimisers with more than HOT different runs.

    Null texts count as empty. A null doc_id counts as greater than all others. A cut inside a
    multi-byte character leaves its remaining bytes. Long texts are read in overlapping pieces.
    Extra columns are ignored; an empty table gives no rows. with_text adds kept_text, without the
    bytes of cut characters, the input row but its text as the struct `row`, and had_text: whether
    the text wasn't null.
    """
    return _removed(docs, plan, search_bytes, with_text).withColumnRenamed("n_units", "n_bytes")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


#: What is left of each row after its hits (row, place), as windows [place, place + {length}): islands, what stands between them, its digest.
SQL_KEPT = """
islands AS (
  SELECT row_no, min(place) AS lo, max(place) + {length} AS hi FROM (
    SELECT row_no, place, sum(fresh) OVER (PARTITION BY row_no ORDER BY place) AS island FROM (
      SELECT row_no, place, (place - lag(place, 1, -1000000) OVER (PARTITION BY row_no ORDER BY place) > {length})::INT AS fresh FROM hits))
  GROUP BY row_no, island
), cuts AS (
  SELECT row_no, hi AS after_, coalesce(lead(lo) OVER (PARTITION BY row_no ORDER BY lo), 1000000000) AS before_ FROM islands
  UNION ALL SELECT row_no, 0, min(lo) FROM islands GROUP BY row_no
)
"""
SQL = {
    "op1_substring_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT row_no, place, array_to_string(w[place + 1:place + 35], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 34)) AS place FROM d)
), hits AS (
  SELECT row_no, place FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1)
), """
    + SQL_KEPT.format(length=35)
    + """, kept AS (
  SELECT row_no, flatten(list(w[after_ + 1:before_] ORDER BY after_)) AS k FROM cuts JOIN d USING (row_no) GROUP BY row_no
), gone AS (
  SELECT row_no, sum(hi - lo) AS n, count(*) AS spans FROM islands GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(array_to_string(coalesce(k, w), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (row_no) LEFT JOIN kept USING (row_no)
""",
    "op6_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(doc_id, 9223372036854775807) AS rank, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT row_no, rank, base, substr(h, 2 * base + 1, 2098) AS piece FROM (SELECT *, unnest(range(0, length(h) // 2, 1000)) AS base FROM d)
), windows AS (
  SELECT row_no, rank, base + step AS place, substr(piece, 2 * step + 1, 100) AS g
  FROM (SELECT *, unnest(range(0, least(1000, length(piece) // 2 - 49))) AS step FROM pieces)
), least AS (
  SELECT g, min(rank) AS least FROM windows GROUP BY g HAVING count(*) > 1
), hits AS (
  SELECT row_no, place FROM windows JOIN least USING (g) WHERE least < rank
), """
    + SQL_KEPT.format(length=50)
    + """, kept AS (
  SELECT row_no, string_agg(substr(h, 2 * after_ + 1, 2 * (least(before_, length(h)) - after_)), '' ORDER BY after_) AS k
  FROM cuts JOIN d USING (row_no) GROUP BY row_no
), gone AS (
  SELECT row_no, sum(hi - lo) AS n, count(*) AS spans FROM islands GROUP BY row_no
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (row_no) LEFT JOIN kept USING (row_no)
""",
}

QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op6_suffix_dedup": op6_suffix_dedup}
