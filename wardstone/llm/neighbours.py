"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_shuffles, rows_of, stored, table

#: Pivots; the nearest of them in whose files a vector is posted and a query looks; those that describe a vector, 128 at most.
PIVOTS, POSTED, COMPARED = 512, 24, 128
#: Vectors of least footrule distance that are reranked for a query: so many, or this share of all vectors if that is more.
RERANKED, SHARE = 512, 0.01
#: Vectors of one shard of the index, about; queries that are dealt to all shards at a time.
SHARD, ASKED = 1 << 15, 1 << 14
#: Vectors of a shard whose files are read at once, and for how many queries, so that they stay in a processor's cache.
FILE, AT_ONCE = 1 << 13, 64


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows scaled by powers of two to components below 1, so that no square leaves the range of doubles; cosines stay as they are."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1))[1][:, None])


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): one vector for each id, of floats or else doubles, without null, zero, non-finite or odd-sized ones.

    Of rows that share an id the least vector counts; the size that most vectors have is the right one, the smaller on ties.
    """
    floats = vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>"
    v = F.col(vector_col).cast("array<float>" if floats else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes[0] if sizes else 0
    return rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))


class Shard:
    """The pivots' files of some vectors, coded densely: for each pivot and vector a weight, COMPARED less the pivot's place in
    the vector's description, 0 if it isn't there. Vectors stand by id, FILE of them in an array.

    The footrule distance of two descriptions of n pivots, each that one lacks standing behind all others, is n * (n + 1)
    less twice the sum, over pivots, of the smaller of both weights: files are read one by one and summed up.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, near: np.ndarray, n_pivots: int, probed: int):
        self.ids, self.values, self.norms = ids, values, np.sqrt((values * values).sum(axis=1))
        self.compared, self.probed, self.files = near.shape[1], probed, []
        weights = np.arange(self.compared, 0, -1, dtype=np.uint8)[:, None]
        wide = min(FILE, len(ids) + len(ids) % 2)
        for at in range(0, len(ids), wide):
            lists = near[at : at + wide].T
            self.files.append(np.zeros((n_pivots, wide), np.uint8))
            self.files[-1][lists, np.arange(lists.shape[1])[None, :]] = weights
        self.weights = np.repeat(weights, wide, axis=1)

    def common(self, near: np.ndarray) -> np.ndarray:
        """For each description and vector the sum of the smaller weights, 0 if they share none of their `probed` nearest pivots."""
        half, wide = self.compared // 2, self.weights.shape[1]
        read, out = np.empty_like(self.weights), np.empty((len(near), len(self.files) * wide), np.uint16)
        pairs = read[: self.compared - half].view("<u2")  # of two vectors
        upper = np.empty_like(pairs)
        for i, files in enumerate(self.files):
            for own, sums in zip(near, out[:, i * wide : (i + 1) * wide], strict=True):
                np.take(files, own, axis=0, out=read, mode="clip")
                np.minimum(read, self.weights, out=read)
                met = read[: self.probed].max(axis=0) > self.compared - self.probed
                # the smaller weights of the first and the last place, of the second and the last but one and so on are 129 together at most
                np.add(read[:half], read[: -half - 1 : -1], out=read[:half])
                second = np.right_shift(pairs, 8, out=upper).sum(axis=0, dtype=np.uint16)
                sums[0::2] = pairs.sum(axis=0, dtype=np.uint16) - (second << 8)
                sums[1::2] = second
                sums *= met
        return out[:, : len(self.ids)]

    def nearest(self, vec_id: int, value: np.ndarray, common: np.ndarray, quota: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k vectors of largest cosine, then smaller id, among the `quota` first by footrule distance, then id."""
        at = int(np.searchsorted(self.ids, vec_id))
        if at < len(self.ids) and self.ids[at] == vec_id:
            common[at] = 0
        counts = np.bincount(common)
        counts[0] = 0  # these it hasn't found
        limit = max(1, len(counts) - 1 - int(np.searchsorted(counts[::-1].cumsum(), quota)))
        best = np.flatnonzero(common >= limit)
        if len(best) > quota:
            best = np.delete(best, np.flatnonzero(common[best] == limit)[quota - len(best) :])
        score = (self.values[best] * value).sum(axis=1) / (self.norms[best] * np.sqrt((value * value).sum()))
        first = np.lexsort((self.ids[best], -score))[:k]
        return self.ids[best[first]], score[first]


def nearest(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    reranked: int = RERANKED,
    share: float = SHARE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k vectors of largest cosine for each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by `every`; all other rows, and other queries, are
    candidates. Every vector is described by its COMPARED nearest pivots in order and posted in
    the inverted files of the POSTED nearest. A query reads the files of its own POSTED nearest
    pivots, ranks what it finds there by footrule distance (pivots that a description lacks stand
    behind all others; ties to the smaller id) and reranks the best by cosine in double precision:
    `reranked` of them, or `share` of all vectors if that is more. Pivots are PIVOTS distinct
    vectors, those of least id hash: a bounded sample; every vector is indexed.

    The index is cut into shards of some SHARD vectors by a hash of their ids, each with files of
    its own, so vectors that are equal or close to one pivot are spread. A vector is moved to its
    shard once and the queries to each; a task holds one shard, streams the queries past it, reranks
    there and passes on k vectors a query, so what a query finds isn't moved. More than ASKED
    queries go in several rounds, whose results are stored: what is on disk at once stays in
    proportion to the vectors. A shard reranks its part of the number above and six standard
    deviations more: as ids are dealt at random, all that one ranking of the whole would rerank is among it.

    Ids or vectors that are null, vectors that are zero, of another size than most, or hold null or
    non-finite components take no part. Of repeated ids one vector counts. Fewer than k candidates
    are all returned: with fewer pivots than a query reads every file is read, and else each file
    holds its pivot.
    """
    spark = vectors.sparkSession
    rows = stored(usable_vectors(vectors, id_col, vector_col), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PIVOTS).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(sample[0].v)
    distinct: dict[bytes, np.ndarray] = {}
    for x in _unit(_matrix(pa.array([row.v for row in sample], pa.list_(pa.float64())), dim)):
        distinct.setdefault(x.round(12).tobytes(), x)
    chosen = np.array(list(distinct.values())[:PIVOTS])
    shipped = spark.sparkContext.broadcast(chosen)  # PIVOTS rows
    n_pivots = len(chosen)
    compared, probed = min(COMPARED, n_pivots), min(POSTED, n_pivots)
    queries = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_queries = rows.count(), queries.count()
    free_shuffles(spark)
    shards, rounds = -(-n_rows // SHARD), max(1, -(-n_queries // ASKED))
    budget = max(k, reranked, int(np.ceil(share * n_rows)))
    quota = budget if shards == 1 else max(k, int(np.ceil(budget / shards + 6 * np.sqrt(budget / shards) + 6)))

    def described(values: np.ndarray) -> np.ndarray:
        return np.argsort(-(_unit(values) @ shipped.value.T), axis=1, kind="stable")[:, :compared]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one shard: its vectors by id, then queries."""
        ids, values, nears, shard = [], [], [], None
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                vec_id, value = rows_of(part, "vec_id").to_numpy(), _matrix(rows_of(part, "v"), dim)
                near, n = described(value), len(part) - rows_of(part, "asks").true_count
                if n:
                    ids.append(vec_id[:n])
                    values.append(value[:n])
                    nears.append(near[:n].astype(np.uint16))
                if n == len(part) or not ids and shard is None:
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(ids), np.concatenate(values), np.concatenate(nears), n_pivots, probed)
                    ids, values, nears = [], [], []
                got = []
                for lo in range(n, len(part), AT_ONCE):
                    common = shard.common(near[lo : lo + AT_ONCE])
                    got += [shard.nearest(vec_id[lo + i], value[lo + i], x, quota, k) for i, x in enumerate(common)]
                query_id = np.repeat(vec_id[n:], [len(x) for x, _ in got])
                found, score = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    indexed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    to_all = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answered(asking: DataFrame) -> DataFrame:
        return (
            indexed.unionByName(asking.select(to_all, F.lit(True).alias("asks"), "vec_id", "v"))
            .repartitionById(shards, "shard")
            .sortWithinPartitions("asks", "vec_id")
            .mapInArrow(search, "query_id long, vec_id long, score double")
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )

    if rounds == 1:
        return answered(queries)
    done = []
    for i in range(rounds):
        done.append(stored(answered(queries.where(F.pmod(F.hash("vec_id"), F.lit(rounds)) == i)), "nearest"))
        free_shuffles(spark)
    return reduce(DataFrame.unionByName, done)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_nearest": op2_nearest}
SQL: dict[str, str] = {}
