"""Best-fit packing of tokenised documents into sequences, planned on the counts of their lengths."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, slices, stored, table
from .encoded import Memory, apart, arrays, coded, gathered, strings

#: Tokens of a sequence; the id that ends each document; bytes of texts that are cut into words at once; words that a process remembers, some 200 bytes each.
CAPACITY, END, SLICE, REMEMBERED = 4096, 1, 1 << 22, 1 << 20

#: row tells pieces apart, as doc_ids may repeat.
PIECES = "row long, doc_id long, piece int, start long, length int, ids binary"
#: Pieces of one length that are numbered together.
GROUP = 512
PLAN = ("length", "first", "n", "bin", "each", "offset")

_memories: dict[int, Memory] = {}


def _memory(model: str) -> Memory:
    """The encoder of this process; the model is loaded once."""
    key = hash(model)
    if key not in _memories:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        mark = next(t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special)
        alone = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        encode = apart(alone, alone, mark, tokenizer.token_to_id(mark))
        _memories[key] = Memory(lambda words: encode([w.decode() for w in words]), REMEMBERED)
    return _memories[key]


def token_pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """row, doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers) of every document, stored.

    model: JSON of a tokenizer that drops white space and starts anew after it, so that the words of a
    text can be encoded one by one; equal ones are encoded once. Only documents of more than
    `capacity` ids are cut. Null texts are empty: their only id is `end`.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(shipped.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = rows_of(batch, "doc_id")
            for part in slices(rows_of(batch, "text"), SLICE):
                starts, ends, firsts = part.words()
                offsets = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=offsets[1:])
                keep = np.zeros(len(part.data) + 1, np.int8)
                keep[starts] += 1
                keep[ends] -= 1  # a word may begin where another document's last one ends
                codes, words = coded(strings(part.data[np.cumsum(keep[:-1]) > 0], offsets))
                flat, places = arrays(memory.of(words.to_pylist()), "<i4")
                ids, lengths = gathered(flat, places, codes)
                upto = np.concatenate([[0], np.cumsum(lengths)])[firsts]
                out: list[tuple] = []
                for i in range(part.n):
                    own = np.append(ids[upto[i] : upto[i + 1]], end).astype("<u4")
                    name = doc_ids[part.first + i].as_py()
                    out += [(row + len(out) + at // capacity, name, at // capacity, at, min(capacity, len(own) - at), own[at : at + capacity].tobytes()) for at in range(0, len(own), capacity)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                    ["row", "doc_id", "piece", "start", "length", "ids"],
                )
                row += len(out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(texts.mapInArrow(encode, PIECES), "pack-pieces")


class _Gaps:
    """Ranges of bins by the room that is left in them. Bins of a range may differ in what they hold."""

    def __init__(self, capacity: int):
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.capacity, self.bins = capacity, 0

    def add(self, gap: int, first: int, n: int) -> None:
        if n:
            self.ranges[gap].append((first, n))

    def least(self, length: int) -> int | None:
        return min((g for g, held in self.ranges.items() if held and g >= length), default=None)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Places for counts[length] items of each length (1 to capacity): rows of PLAN, and the number of bins.

    A row puts items first to first + n - 1 of a length into bins from `bin` on, `each` to a bin, from
    `offset` on. Items above a third of the capacity, of which a bin holds two at most, are matched
    greedily: the longest with the longest that fits beside it, which needs the fewest bins for them.
    The others, longest first, fill the least gap that takes them, and then bins of their own.

    Work and rows depend on the number of different lengths alone: items of a length move together,
    and a range of bins that takes items is left with less than half of its gap.
    """
    rows: list[tuple[int, ...]] = []
    gaps, used, left = _Gaps(capacity), dict.fromkeys(counts, 0), {k: n for k, n in counts.items() if n}

    def put(length: int, n: int, first_bin: int, each: int, offset: int) -> None:
        rows.append((length, used[length], n, first_bin, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, gaps.bins, 1, 0)
            if b is not None:
                put(b, n, gaps.bins, 1, a)
            gaps.add(capacity - a - (b or 0), gaps.bins, n)
            gaps.bins += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            gap = gaps.least(s)
            if gap is None:  # bins of their own
                each = capacity // s
                gap, n = capacity, -(-left[s] // each)
                gaps.add(capacity, gaps.bins, n)
                gaps.bins += n
            first, n = gaps.ranges[gap].pop()
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                gaps.add(gap - each * s, first, full)
            if full < n and left[s]:  # the last items of a length share one bin
                some = left[s]
                put(s, some, first + full, some, capacity - gap)
                gaps.add(gap - some * s, first + full, 1)
                full += 1
            gaps.add(gap, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, len(PLAN)), gaps.bins


def numbered_by_length(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """pieces (row, length and others) with place: the number of each among those of its length, from 0. counts: pieces of each length.

    The pieces of a length are dealt into groups of about GROUP by a hash, numbered in each and set off
    by the groups before, so that a length that most documents have is no single group.
    """
    spark = pieces.sparkSession
    groups = spark.createDataFrame([(k, n // GROUP + 1) for k, n in counts.items()], "length int, groups long")
    rows = pieces.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int")).drop("groups")  # a row a length
    sizes = rows.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "group").orderBy("row")
    return rows.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "group"]).withColumn("place", F.col("base") + F.col("own")).drop("group", "own", "base")


def placed_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32, sequence_id, offset for the pieces that token_pieces() gives.

    Only the counts of lengths, `capacity` rows at most, reach the driver. The plan that comes back is
    bounded as plan_bins() says (some 150,000 rows for 4096 tokens, whatever the number of documents).
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    plan, _ = plan_bins(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shipped = spark.sparkContext.broadcast((plan[:, 0] << 40 | plan[:, 1], plan))
    rows = numbered_by_length(pieces.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), counts)
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known = shipped.value
        for batch in batches:
            length, number = (rows_of(batch, c).to_numpy().astype(np.int64) for c in ("length", "place"))
            row = known[np.searchsorted(keys, length << 40 | number, "right") - 1]
            inside = number - row[:, 1]
            each = np.maximum(row[:, 4], 1)
            yield pa.RecordBatch.from_arrays(
                [*[rows_of(batch, c) for c in names], pa.array(row[:, 3] + inside // each), pa.array(row[:, 5] + inside % each * length)],
                [*names, "sequence_id", "offset"],
            )

    return rows.select(*names, "place").mapInArrow(
        place, "row long, doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, model: str, capacity: int = CAPACITY, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, places of pieces, by row) for all documents, in as few sequences as best-fit packing finds.

    Every row gives a document, whatever its doc_id, repeated and null ones too; null and empty texts
    give one piece with the id `end`; extra columns are ignored; an empty table gives no rows.
    """
    pieces = token_pieces(docs, model, capacity, end)
    return pieces, placed_pieces(pieces, capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences, from what pack() gives."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of one sequence, so at most its capacity
    joined = places.select("row", "sequence_id", "offset").join(pieces.select("row", "ids"), "row").groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x.ids))
    return joined.select("sequence_id", (F.octet_length(ids) / 4).cast("int").alias("length"), ids.alias("ids"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        model = f.read()
    _, places = pack(table(spark, sf_dir, "documents"), model)
    return places.drop("row").withColumn("length", F.col("length").cast("long"))


QUERIES = {"op12_best_fit_packing": op12_best_fit_packing}
SQL: dict[str, str] = {}
