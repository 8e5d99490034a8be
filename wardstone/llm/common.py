"""Shared helpers of the training-data operators: scratch tables and batch text kernels.

The numpy kernels work on the byte buffer of an Arrow string column, so a batch is
tokenised and hashed without a Python object per word.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are neither space nor one of \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None
#: Path, table name and owner of what stored() and stored_by() have written, and who owns what is written now.
_stored: list[tuple[str, str | None, str | None]] = []
_owner: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only on one machine (master local) may it be unset: a folder of our own serves then."""
    global _own_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-wardstone-")
    return _own_dir


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/wardstone/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _stored.append((path, None, _owner))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_by(df: DataFrame, key: str, n_parts: int, tag: str, placed: bool = False) -> DataFrame:
    """Like stored(), bucketed by a column: later joins on it move the other side only. placed: rows lie in their bucket's partition already."""
    spark = df.sparkSession
    name = f"wardstone_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/wardstone/{tag}-{name}"
    rows = df if placed else df.repartition(n_parts, key)
    rows.write.bucketBy(n_parts, key).option("compression", "zstd").option("path", path).saveAsTable(name, format="parquet")
    _stored.append((path, name, _owner))
    out = spark.table(name)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again, as what was made from it is stored itself."""
    for entry in [x for x in _stored if x[0] == df.stored_at]:
        _stored.remove(entry)
        _delete(df.sparkSession, *entry[:2])


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is stored meanwhile belongs to this owner."""
    global _owner
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before


def release(spark: SparkSession, owner: str) -> None:
    """Delete the tables of an owner whose results so far are written elsewhere. Others' frames go on reading theirs."""
    for entry in [x for x in _stored if x[2] == owner]:
        _stored.remove(entry)
        _delete(spark, *entry[:2])


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no live frame needs, as those before a stored table; it acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def size_of(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the text column."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text).cast("long"))).first()
    return row[0], row[1] or 0


def partitions_for(spark: SparkSession, n_bytes: float, each: int = 16 << 20) -> int:
    """Enough partitions that each holds about `each` bytes, and no fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // each) + 1)


def narrowed(df: DataFrame, n_rows: int, each: int = 1 << 16) -> DataFrame:
    """df in no more tasks than its rows need, about `each` in a task, but as many as there are cores. Partitions are joined, rows aren't dealt anew."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, n_rows // each + 1))


def row_key(*cols: str) -> Column:
    return F.xxhash64(*cols)


# ---------------------------------------------------------------- text kernels

_is_space = np.zeros(256, bool)
_is_space[[32, 9, 10, 11, 12, 13]] = True
#: Bytes with A-Z replaced by a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest n bytes of a 64-bit number.
_LOWEST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_EIGHT = np.arange(8)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a string past which its hash is the standard library's BLAKE2; of a block that is read at a time; of a long row.
LONG_WORD, BLOCK, LONG_ROW = 256, 1 << 20, 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied to a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Slice:
    """Some whole documents of a batch: data (bytes), offsets (n + 1), first (row of the batch)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document the index of its first word (n + 1 entries)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        starts, ends = [], []
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            space = np.ones(hi - lo + 2, bool)
            space[lo == 0 : hi - lo + 2 - (hi == n)] = _is_space[self.data[max(0, lo - 1) : hi + 1]]
            inside = ~space[1:-1]
            starts.append(lo + np.flatnonzero(inside & (space[:-2] | edge[lo:hi])))
            ends.append(lo + np.flatnonzero(inside & (space[2:] | edge[lo + 1 : hi + 1])) + 1)
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lowered(self) -> Slice:
        """The same with A-Z as a-z."""
        return Slice(_LOWER[self.data], self.offsets, self.first)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).astype(np.uint64)


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string [start, end) of data, wherever it stands: eight bytes at a time are mixed in."""
    out = np.zeros(len(starts), np.uint64)
    each = BLOCK // 16
    for first in range(0, len(starts), each):
        low, high = starts[first : first + each], ends[first : first + each]
        length = high - low
        short = np.flatnonzero(length <= LONG_WORD)
        hashes = length.astype(np.uint64) * _STEP
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            hashes[i] = int.from_bytes(hashlib.blake2b(data[low[i] : high[i]], digest_size=8).digest(), "little")
        for done in range(0, int(length[short].max()) if len(short) else 0, 8):
            if done:
                short = short[length[short] > done]
            places = (low[short] + done)[:, None] + _EIGHT
            value = data[np.minimum(places, len(data) - 1)].view("<u8").reshape(-1)
            hashes[short] = mix(hashes[short] ^ (value & _LOWEST[np.minimum(length[short] - done, 8)]))
        out[first : first + each] = hashes
    return out


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence [start, end) of hashes, wherever it stands; for sequences of bounded length."""
    length = ends - starts
    out = length.astype(np.uint64) * _STEP
    active = np.arange(len(starts))
    for done in range(int(length.max()) if len(length) else 0):
        active = active[length[active] > done]
        one = (out[active] ^ values[starts[active] + done]) * _STEP
        out[active] = one ^ (one >> np.uint64(29))
    return mix(out)


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[Slice]:
    """Cut a string column into runs of whole rows of about `limit` bytes; a longer row stands alone. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Slice(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each of len(hashes) - n + 1 places of a sequence of token hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count]
    return mix(out)


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
