"""Vectors in tiles: a block of rows as one matrix, so that two tables of vectors meet tile by tile as Spark rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

#: Bytes of a tile's matrix, rows of a tile of the stated side, and bytes of all stated tiles that are broadcast.
TILE_BYTES, STATED_ROWS, BROADCAST_BYTES = 4 << 20, 2048, 64 << 20
#: Products of a pair of tiles that are in memory at once, whatever the tiles' sizes: 8 bytes each, a few arrays of them.
BLOCK = 1 << 20


def whole(v: Column) -> Column:
    """Whether a vector is there, with components and none of them null."""
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(True)) & (F.size(v) > 0)


def unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return values / np.where(norm == 0, 1, norm)


def tiles(rows: DataFrame, prefix: str, order: tuple[str, ...] = ()) -> DataFrame:
    """rows (v array<double>, whole, and others) as tiles: size, prefix + column as an array for each other column, prefix + m the unit vectors.

    Within a tile rows stand by the columns of `order`.
    """
    names = [c for c in rows.columns if c != "v"]
    schema = StructType().add("size", IntegerType())
    for c in names:
        schema = schema.add(prefix + c, ArrayType(rows.schema[c].dataType))
    schema = schema.add(prefix + "m", BinaryType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if order:
                batch = batch.sort_by([(c, "ascending") for c in order])
            vectors = batch.column("v")
            sizes = np.diff(np.asarray(vectors.offsets))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                each = max(1, TILE_BYTES // (8 * int(size)))
                for at in range(0, len(own), each):
                    part = batch.take(pa.array(own[at : at + each]))
                    matrix = unit(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in names]
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *lists, pa.array([matrix.tobytes()], pa.binary())], schema.fieldNames())

    return rows.select(*names, "v").mapInArrow(pack, schema)


def tile_pairs(stated: DataFrame, table: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Every tile of `stated` (columns q_...) beside every tile of `table` (c_...) of the same vector size.

    The stated side is dealt into tiles of about STATED_ROWS. If they are BROADCAST_BYTES at most by
    count and size they go to the tasks, and the table isn't moved; else table tiles are dealt to
    slices by hash, and each slice gets a copy of the stated tiles. Nothing passes through the driver.
    """
    spark = stated.sparkSession
    n, n_bytes = stated.agg(F.count(F.lit(1)), F.sum(F.size("v").cast("long") * 8)).first()
    left = tiles(stated.repartition(max(1, -(-n // STATED_ROWS))), "q_")
    right = tiles(table, "c_", order)
    if (n_bytes or 0) <= BROADCAST_BYTES:
        return right.join(F.broadcast(left), "size")
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return right.withColumn("slice", F.pmod(F.xxhash64("c_m"), F.lit(slices)).cast("int")).join(copies, ["size", "slice"])


def matrix(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    size = batch.column("size")[i].as_py()
    return np.frombuffer(batch.column(name)[i].as_buffer(), np.float64).reshape(-1, size)


def column(batch: pa.RecordBatch, name: str, i: int) -> pa.Array:
    return batch.column(name)[i].values
