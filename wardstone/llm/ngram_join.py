"""Near-duplicate documents: an exact Jaccard join of word shingles by rare-first prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slice, discard, free_shuffles, grams, mix, narrowed, rows_of, sequence_hashes, slices, stored, stored_by, string_hashes, table
from .components import components
from .shared_keys import with_shared_keys

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles are ordered by how often their cell of this many (a power of 2) occurs, rarest first.
CELL_BITS = 22
#: Partners that one task compares with a copy of a pivot, about.
CHUNK = 128

#: 64-bit words of a set's bitmap, and parts of the hash range whose values are counted beside it; minor sets of a group that one task holds.
BITMAP, PARTS, MINORS = 16, 16, 1024
WIDTH = BITMAP + PARTS // 2

SET_SCHEMA = "rid long, doc_id long, key long, n int, text string, shingles array<long>, places array<int>, signature array<long>"


def shingle_sets(part: Slice, n: int = SHINGLE) -> list[np.ndarray]:
    """The set of each document of a slice, as ascending hashes: distinct n-word shingles with A-Z
    lower-cased; of fewer words, the whole sequence as one; empty without words."""
    starts, ends, offsets = part.words()
    words = string_hashes(part.lowered().data, starts, ends)
    all_grams = grams(words, n)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(all_grams[lo : hi - n + 1]))
        elif hi > lo:
            out.append(sequence_hashes(words, np.array([lo]), np.array([hi])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n of which any partner's prefix holds one at least."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _set_key(values: np.ndarray) -> int:
    """Identity of a set, the same for all texts with equal sets."""
    if not len(values):
        return 0
    total = np.add.reduce(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(mix(np.array([total], np.uint64) + np.uint64(len(values))).view(np.int64)[0])


def _signature(values: np.ndarray) -> np.ndarray:
    """A bitmap with a bit for each value, by its hash, and how many values lie in each part of the hash range."""
    out = np.zeros(WIDTH, np.uint64)
    cells = (values >> np.uint64(20)) % np.uint64(64 * BITMAP)
    np.bitwise_or.at(out, (cells >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cells & np.uint64(63)))
    out[BITMAP:].view(np.uint32)[:] = np.bincount((values >> np.uint64(60)).astype(np.int64), minlength=PARTS)
    return out.view(np.int64)


def may_share(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bitmap and suffix filters, row by row: whether sets of n_a and n_b values with signatures a and b may link.

    A bit that the other bitmap lacks is a value that the other set lacks. What follows a set's
    values in the order of hashes is cut into PARTS, and two sets share in each part the lesser
    number at most.
    """
    x, y = a[:, :BITMAP], b[:, :BITMAP]
    most = np.minimum(n_a - np.bitwise_count(x & ~y).sum(axis=1), n_b - np.bitwise_count(y & ~x).sum(axis=1))
    counts_a, counts_b = (np.ascontiguousarray(s[:, BITMAP:]).view(np.uint32) for s in (a, b))
    most = np.minimum(most, np.minimum(counts_a, counts_b).sum(axis=1, dtype=np.int64))
    return most * (100 + PERCENT) >= (n_a.astype(np.int64) + n_b) * PERCENT


def cell_counts(docs: DataFrame, n: int = SHINGLE, bits: int = CELL_BITS) -> np.ndarray:
    """How many shingles of all documents fall into each cell of the hash; a table of fixed size.

    Tasks send a compressed block of counts for each of 64 runs of cells, which are summed as they come.
    """
    width = (1 << bits) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gathered, held = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            for part in slices(rows_of(batch, "text")):
                starts, ends, _ = part.words()
                gathered.append((grams(string_hashes(part.lowered().data, starts, ends), n) >> np.uint64(64 - bits)).astype(np.int32))
                held += len(gathered[-1])
                if held > 1 << bits:
                    total += np.bincount(np.concatenate(gathered), minlength=1 << bits)
                    gathered, held = [], 0
        if held:
            total += np.bincount(np.concatenate(gathered), minlength=1 << bits)
        blobs = [pa.compress(total[i * width : (i + 1) * width].astype(np.uint32).tobytes(), "zstd", asbytes=True) for i in range(64)]
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(blobs, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(rows_of(batch, "block").to_pylist(), rows_of(batch, "counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(pa.decompress(blob, 4 * width, "zstd", asbytes=True), np.uint32).astype(np.int64)
        if sums:
            blobs = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], ["block", "counts"])

    rows = (
        docs.select("text")
        .mapInArrow(count, "block int, counts binary")
        .repartition(64, "block")
        .mapInArrow(add, "block int, counts binary")
        .collect()
    )  # 64 rows, 4 bytes for each cell
    out = np.zeros(1 << bits, np.uint32)
    for row in rows:
        out[row.block * width : (row.block + 1) * width] = np.frombuffer(row.counts, np.uint32)
    return out


def _sets(docs: DataFrame) -> tuple[DataFrame, int]:
    """A row for each document. The first of equal sets in a task keeps its text and the prefix
    shingles that other documents' prefixes may hold, with their places in the rare-first order."""
    counts = docs.sparkSession.sparkContext.broadcast(cell_counts(docs))

    def prefix(values: np.ndarray) -> np.ndarray:
        order = np.argsort(counts.value[(values >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
        return values[order[: prefix_size(len(values))]]

    def keys_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
        prefixes = [prefix(x) for x in shingle_sets(part)]
        doc = np.repeat(np.arange(part.n), [len(x) for x in prefixes])
        return (np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)), doc

    seen: set[int] = set()

    def emit(part: Slice, rows: pa.RecordBatch, shared: Callable) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"key": [], "n": [], "text": [], "shingles": [], "places": [], "signature": []}
        data, offsets = part.data.tobytes(), part.offsets
        for i, values in enumerate(shingle_sets(part)):
            key = _set_key(values)
            text, mine, places, bits = None, None, None, None
            if len(values) and key not in seen:
                seen.add(key)
                first = prefix(values)
                places = np.flatnonzero(shared(first))
                if len(places):
                    mine, text, bits = first[places].view(np.int64), data[offsets[i] : offsets[i + 1]].decode(), _signature(values)
                else:
                    places = None
            for name, value in zip(out, (key, len(values), text, mine, places, bits), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [
                rows_of(rows, "rid"),
                rows_of(rows, "doc_id"),
                pa.array(out["key"], pa.int64()),
                pa.array(out["n"], pa.int32()),
                pa.array(out["text"], pa.string()),
                pa.array(out["shingles"], pa.list_(pa.int64())),
                pa.array(out["places"], pa.list_(pa.int32())),
                pa.array(out["signature"], pa.list_(pa.int64())),
            ],
            ["rid", "doc_id", "key", "n", "text", "shingles", "places", "signature"],
        )

    return with_shared_keys(docs, keys_of, emit, SET_SCHEMA, 1 / 25)


def _may_link(n_a: Column, place_a: Column, n_b: Column, place_b: Column) -> Column:
    """Length and positional filters. For two linked sets their first common shingle passes both."""
    long_enough = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    needed = (n_a + n_b) * PERCENT
    return long_enough & ((F.least(n_a - place_a, n_b - place_b)) * (100 + PERCENT) >= needed)


def _across_classes(rest: DataFrame, loads: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different classes that share a prefix shingle and pass all filters, each pair once.

    rest: shingle, key, n, place, class; loads: shingle, major, minors; signatures: key, signature.
    Minor sets, those outside the group's largest class, are held MINORS at a time in a task, past
    which the whole group streams in slices. Held sets come first and by key, so of two in different
    slices the earlier one has the lesser key. A task sends each minor set's partners as one list,
    and a second pass by set leaves each partner once.
    """
    spark = rest.sparkSession
    chunked = (
        rest.join(loads.withColumn("chunks", F.ceil(F.col("minors") / MINORS).cast("int")), "shingle")
        .withColumn("home", F.when(F.col("class") != F.col("major"), F.pmod(F.xxhash64("key"), "chunks").cast("int")).otherwise(-1))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .join(signatures, "key")
        .select("shingle", "chunk", (F.col("home") == F.col("chunk")).alias("held"), "key", "n", "place", "class", "major", "signature")
    )

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return rows_of(batch, name).to_numpy(zero_copy_only=False)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            shingle, chunk = numbers(batch, "shingle"), numbers(batch, "chunk")
            columns = [numbers(batch, c) for c in ("held", "key", "n", "place", "class", "major")]
            bits = rows_of(batch, "signature").flatten().to_numpy().view(np.uint64).reshape(-1, WIDTH)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            edges = np.flatnonzero((np.diff(shingle) != 0) | (np.diff(chunk) != 0)) + 1
            edges = sorted({0, len(shingle), *edges.tolist(), *range(0, len(shingle), MINORS)})
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if (shingle[lo], chunk[lo]) != current:
                    current, held = (shingle[lo], chunk[lo]), []
                is_held, key, n, place, class_, major = (c[lo:hi] for c in columns)
                own = np.flatnonzero(is_held.astype(bool))
                if len(own):
                    held.append((key[own], n[own], place[own], class_[own], bits[lo + own]))
                for a_key, a_n, a_place, a_class, a_bits in held:
                    total = a_n[:, None] + n[None, :]
                    ok = np.minimum(a_n[:, None], n[None, :]) * 100 >= np.maximum(a_n[:, None], n[None, :]) * PERCENT
                    ok &= np.minimum((a_n - a_place)[:, None], (n - place)[None, :]) * (100 + PERCENT) >= total * PERCENT
                    ok &= (a_class[:, None] != class_[None, :]) & ((class_ == major)[None, :] | (a_key[:, None] < key[None, :]))
                    i, j = np.nonzero(ok)
                    on = np.concatenate([np.zeros(0, bool)] + [
                        may_share(a_n[i[k : k + 65536]], a_bits[i[k : k + 65536]], n[j[k : k + 65536]], bits[lo + j[k : k + 65536]])
                        for k in range(0, len(i), 65536)
                    ])
                    found.append((a_key[i[on]], key[j[on]]))
            if found:
                yield from lists_of(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def lists_of(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        blobs = [b[lo:hi].tobytes() for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(a)], strict=True)] if len(a) else []
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(a[heads], pa.int64()), pa.array(blobs, pa.binary())], ["a", "partners"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mine = None, []

        def unique() -> pa.RecordBatch:
            partners = np.unique(np.concatenate(mine))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(partners), current), pa.int64()), pa.array(partners, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, blob in zip(rows_of(batch, "a").to_pylist(), rows_of(batch, "partners"), strict=True):
                if a != current:
                    if mine:
                        yield unique()
                    current, mine = a, []
                mine.append(np.frombuffer(blob.as_py(), np.int64))
        if mine:
            yield unique()

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        chunked.repartition(n_parts, "shingle", "chunk")
        .sortWithinPartitions("shingle", "chunk", F.desc("held"), "key")
        .mapInArrow(pairs, "a long, partners binary")
        .repartition(n_parts, "a")
        .sortWithinPartitions("a")
        .mapInArrow(once, "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or small * 100 < large * PERCENT:
        return False
    common_ = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common_ >= PERCENT * (len(a) + len(b) - common_)


def _filtered(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that pass the bitmap and suffix filters."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n_a, a), (n_b, b) = (
                (rows_of(batch, n).to_numpy(), rows_of(batch, s).flatten().to_numpy().view(np.uint64).reshape(-1, WIDTH))
                for n, s in (("n_a", "s_a"), ("n_b", "s_b"))
            )
            yield batch.select(["a", "b"]).filter(pa.array(may_share(n_a, a, n_b, b)))

    of = [signatures.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab"]
    return pairs.join(of[0], "a").join(of[1], "b").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link, as (u, v). A pivot b with many partners is copied to several tasks."""
    spark = pairs.sparkSession
    pairs = stored(pairs, "pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    free_shuffles(spark)
    loads = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    loads = stored(narrowed(loads, n_pairs), "pivots")
    pairs = pairs.join(loads, "b").select("a", "b", F.pmod(F.xxhash64("a"), "chunks").cast("int").alias("chunk"))
    pivots = loads.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = (
        pivots.join(texts, F.col("b") == F.col("key"))
        .select("b", "chunk", F.lit(None).cast("long").alias("a"), "text")
        .unionByName(pairs.join(texts, F.col("a") == F.col("key")).select("b", "chunk", "a", "text"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            b, chunk, a = (rows_of(batch, c).to_pylist() for c in ("b", "chunk", "a"))
            found: list[tuple[int, int]] = []
            for part in slices(rows_of(batch, "text")):
                for i, values in enumerate(shingle_sets(part), part.first):
                    if (b[i], chunk[i]) != current:
                        current, pivot = (b[i], chunk[i]), np.zeros(0, np.uint64)
                    if a[i] is None:
                        pivot = values
                    elif linked(values, pivot):
                        found.append((a[i], b[i]))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_pairs // 2000)
    dealt = narrowed(rows.repartition(n_parts, "b", "chunk"), n_pairs, 1000)
    return stored(dealt.sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first()).mapInArrow(compare, "u long, v long"), "verified")


def _with_links(forest: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the components of a forest and further links; few steps, as the forest's trees are stars."""
    return components(forest.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def _classed(grouped: DataFrame, forest: DataFrame, n_parts: int) -> DataFrame:
    """The postings with the class of each set: the root of its tree, or itself; dealt out by shingle, as they were."""
    return stored_by(
        grouped.drop("p").join(forest, F.col("key") == F.col("node"), "left").select(
            "shingle", "key", "n", "place", F.coalesce("root", "key").alias("class")
        ),
        "shingle",
        n_parts,
        "classed",
    )


def _between_classes(
    classed: DataFrame, tried: DataFrame, signatures: DataFrame, texts: DataFrame, end: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame]:
    """(pairs compared, links): each set outside a group's largest class against one set of that class, its least or greatest."""
    by_class = classed.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("size"), end(F.struct("key", "n", "place")).alias("p"))
    tops = by_class.groupBy("shingle").agg(F.max(F.struct("size", "class", "p")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    candidates = classed.join(tops, "shingle").where(
        (F.col("class") != F.col("top.class")) & _may_link(F.col("n"), F.col("place"), F.col("top.p.n"), F.col("top.p.place"))
    ).groupBy(F.col("key").alias("a"), F.col("top.p.key").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    fresh = candidates.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(
        tried.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti"
    )
    best = fresh.groupBy("a").agg(F.max(F.struct("common", "b")).alias("best")).select("a", "best.b")
    pairs = stored(_filtered(best, signatures), "class-pairs")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), _verified(pairs, texts)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each input row.

    Exact: two documents link when 100 * |intersection| >= 80 * |union| of their shingle sets.
    Texts with equal sets count as one set. Sets are joined on prefix shingles, rarest first, that
    occur in two prefixes at least. To lose no link and not emit all pairs of a group:

    1. the least key of a prefix shingle's group is its pivot; every set is compared with the one
       pivot that it shares most prefix shingles with, and links give classes; up to three times
       more each set outside a group's largest class is compared with one set of that class;
    2. then only pairs of different classes are left. In a prefix shingle's group these are the
       sets outside its largest class, against all of the group.

    In both steps length, positional, bitmap and suffix filters cut pairs before any text moves,
    and each pair is compared once.

    Null, empty and blank texts have no shingles and stand alone with their own doc_id. Null
    doc_ids take part and are never the smallest unless alone. Repeated rows have equal sets, so
    they link. Very long texts are read whole. Extra columns are ignored; an empty table gives
    no rows. Shingles and sets are compared by 64-bit hashes.
    """
    members, least = _members(docs)
    whole = members.where("n_shingles > 0").join(least, "class").select("doc_id", "n_shingles", "component_id")
    return whole.unionByName(
        members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def row_id() -> Column:
    """Identity of a row by its doc_id and text; repeated rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def id_column(docs: DataFrame) -> str:
    """A name for row_id() that no column of docs has."""
    name = "row_id"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (null last), of repeated rows one; rows without shingles all stay."""
    members, least = _members(docs)
    alone = members.where("n_shingles = 0").select("rid")
    kept = stored(least.select(F.col("first.rid").alias("rid")).unionByName(alone), "kept-rows")
    repeated = stored(members.groupBy("rid").count().where("count > 1").select("rid"), "repeated-rows")
    discard(members)
    discard(least)
    free_shuffles(docs.sparkSession)
    name = id_column(docs)
    named = docs.withColumn(name, row_id()).join(kept.withColumnRenamed("rid", name), name, "left_semi")
    if repeated.isEmpty():
        return named.drop(name)
    again = repeated.withColumnRenamed("rid", name)
    row = F.struct(*[F.col(f"`{c}`") for c in named.columns])
    least = named.join(again, name, "left_semi").groupBy(name).agg(F.min_by(row, F.to_json(row)).alias("row"))  # the same one in every run
    one = least.select("row.*")
    return named.join(again, name, "left_anti").unionByName(one).drop(name)


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, n_shingles, class) of each row; (class, component_id, first) of each class with shingles."""
    spark = docs.sparkSession
    docs = docs.select(row_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found, n_parts = _sets(docs)
    sets = stored_by(found, "key", n_parts, "shingle-sets")
    free_shuffles(spark)
    texts = sets.where(F.col("text").isNotNull()).select("key", "text").dropDuplicates(["key"])
    signatures = sets.where(F.col("signature").isNotNull()).select("key", "n", "signature").dropDuplicates(["key"])
    postings = sets.where(F.col("text").isNotNull()).select(
        "key", "n", F.explode(F.arrays_zip("shingles", "places")).alias("x")
    ).select("key", "n", F.col("x.shingles").alias("shingle"), F.col("x.places").alias("place"))

    # dealt out by shingle once: groups' pivots and classes, and joins with these, move no postings again
    dealt = stored_by(postings.repartition(n_parts, "shingle").distinct(), "shingle", n_parts, "all-postings", placed=True)
    pivots = dealt.groupBy("shingle").agg(
        F.min(F.struct("key", "n", "place")).alias("p"), F.max("key").alias("last")
    ).where("p.key <> last").select("shingle", "p")
    grouped = stored_by(dealt.join(pivots, "shingle"), "shingle", n_parts, "postings")
    discard(dealt)
    candidates = grouped.where(
        (F.col("key") != F.col("p.key")) & _may_link(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place"))
    ).groupBy(F.col("key").alias("a"), F.col("p.key").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    best = candidates.groupBy("a").agg(F.max(F.struct("common", "b")).alias("x")).select("a", "x.b")
    first_pairs = stored(_filtered(best, signatures), "star-pairs")
    links = _verified(first_pairs, texts)
    free_shuffles(spark)

    tried = first_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    forest = components(links)
    classed = _classed(grouped, forest, n_parts)
    for end in (F.min, F.max, F.min):
        pairs, more = _between_classes(classed, tried, signatures, texts, end)
        tried = tried.unionByName(pairs)
        if more.isEmpty():
            break
        forest = _with_links(forest, more)
        discard(classed)
        classed = _classed(grouped, forest, n_parts)
        free_shuffles(spark)
    discard(grouped)
    by_class = classed.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("size"))
    loads = by_class.groupBy("shingle").agg(
        F.max(F.struct("size", "class")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("classes")
    ).where("classes > 1").select("shingle", F.col("top.class").alias("major"), (F.col("all") - F.col("top.size")).alias("minors"))
    loads = stored(loads, "open-groups")
    second = _across_classes(classed, loads, signatures.drop("n"))
    more = _verified(second.join(tried, ["a", "b"], "left_anti"), texts)
    discard(classed)
    free_shuffles(spark)

    if not more.isEmpty():
        forest = _with_links(forest, more)
    members = stored(
        sets.select("rid", "doc_id", "key", "n").join(forest, F.col("key") == F.col("node"), "left").select(
            "rid", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "key").alias("class")
        ),
        "members",
    )
    discard(sets)
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), "rid")
    least = members.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min(first).alias("first"))
    return members, stored(least, "class-least")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL_SETS = """
words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {docs}
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
)
"""

QUERIES = {"op5_ngram_join": op5_ngram_join}
SQL = {
    "op5_ngram_join": "WITH RECURSIVE "
    + SQL_SETS.format(docs="documents")
    + "SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sets"
}
