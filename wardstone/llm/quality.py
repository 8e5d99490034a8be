"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Slice, rows_of, slices, string_hashes, table

#: Words of a passage; a shorter rest is a passage of its own.
PASSAGE = 40
#: The classifier is fitted on at most so many labelled documents, whole, that have so many passages together.
TRAIN_DOCS, TRAIN_PASSAGES = 3000, 200_000
THRESHOLD = 0.7

_CLASSES = 24
_class_of = np.full(256, 0, np.int64)
for _i, _group in enumerate(
    [range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"'\"", b"-", b":;", b"()[]{}<>",
     b"|", b"%", b"#", b"$", b"&", b"*", b"@/\\_=+~^`", range(128, 192), range(192, 256)], 1
):
    _class_of[list(_group)] = _i
_SHAPES = 6
#: Cells that words and pairs of neighbours fall into by their hash.
_GRAMS = 64
FEATURES = _CLASSES + _SHAPES + _GRAMS + 2


def passage_features(part: Slice, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a slice, and the number of passages of each document (at least one: an empty one)."""
    starts, ends, offsets = part.words()
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // passage))
    total = int(counts.sum())
    began = np.cumsum(counts) - counts
    features = np.zeros((total, FEATURES))
    n_words = np.zeros(total)
    if len(starts):
        doc = np.repeat(np.arange(part.n), sizes)
        at = began[doc] + (np.arange(len(starts)) - offsets[doc]) // passage
        n_words = np.bincount(at, minlength=total).astype(float)
        per_byte = np.zeros(len(part.data), np.int64)
        heads = np.append(True, at[1:] != at[:-1])
        # a passage's bytes run from its first word to the next passage's first word
        per_byte[starts[heads]] = np.diff(np.append(0, at[heads]))
        per_byte[: starts[0]] = 0
        own = np.cumsum(per_byte)
        classes = np.bincount(own * _CLASSES + _class_of[part.data], minlength=total * _CLASSES).reshape(total, _CLASSES)
        features[:, :_CLASSES] = classes / np.maximum(1, classes.sum(axis=1, keepdims=True))
        hashes = string_hashes(part.data, starts, ends)
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        second = np.zeros(len(starts), bool)
        second[2:] = (hashes[2:] == hashes[:-2]) & (doc[2:] == doc[:-2])
        first, last = _class_of[part.data[starts]], _class_of[part.data[ends - 1]]
        shapes = [again, second, first == 2, last == 2, (last >= 7) & (last <= 21), (ends - starts) == 1]
        for i, shape in enumerate(shapes):
            features[:, _CLASSES + i] = np.bincount(at, shape, minlength=total) / np.maximum(1, n_words)
        joined = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
        pairs = np.flatnonzero((doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
        cells = np.concatenate([at * _GRAMS + (hashes >> np.uint64(58)).astype(np.int64), at[pairs] * _GRAMS + (joined[pairs] >> np.uint64(58)).astype(np.int64)])
        grams = np.bincount(cells, minlength=total * _GRAMS).reshape(total, _GRAMS)
        features[:, _CLASSES + _SHAPES : -2] = grams / np.maximum(1, grams.sum(axis=1, keepdims=True))
        features[:, -2] = np.bincount(at, ends - starts, minlength=total) / np.maximum(1, n_words) / 10
    features[:, -1] = n_words / passage
    return features, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Passage encoder, gated attention over a document's passages, and a logistic score of the weighted representation."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    @staticmethod
    def _forward(w: dict, x: np.ndarray, heads: np.ndarray, doc: np.ndarray):
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        t, s = np.tanh(h @ w["look"]), _sigmoid(h @ w["gate"])
        energy = (t * s) @ w["attend"]
        energy = np.exp(energy - np.maximum.reduceat(energy, heads)[doc])
        a = energy / np.add.reduceat(energy, heads)[doc]
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return h, t, s, a, z, _sigmoid(z @ w["score"] + w["score_0"])

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        heads = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        return self._forward(self.weights, (features - self.mean) / self.scale, heads, doc)[-1]

    @classmethod
    def fit(
        cls, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, width: int = 16, steps: int = 200, rate: float = 0.03
    ) -> GatedAttention:
        """Full-batch Adam on the mean log loss, classes weighted evenly, with weight decay. Same input, same model."""
        mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        x, heads = ((features - mean) / scale).astype(np.float32), np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        rng = np.random.default_rng(7)
        w = {
            "encode": rng.normal(0, 0.2, (x.shape[1], width)), "encode_0": np.zeros(width),
            "look": rng.normal(0, 0.2, (width, width)), "gate": rng.normal(0, 0.2, (width, width)),
            "attend": rng.normal(0, 0.2, width), "score": rng.normal(0, 0.2, width), "score_0": np.zeros(1),
        }
        share = labels.mean()
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(labels)
        first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            h, t, s, a, z, p = cls._forward(w, x, heads, doc)
            d = weight * (p - labels)
            dz = d[:, None] * w["score"]
            da = (h * dz[doc]).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, heads)[doc])
            dt, ds = de[:, None] * w["attend"] * s * (1 - t * t), de[:, None] * w["attend"] * t * s * (1 - s)
            dh = (a[:, None] * dz[doc] + dt @ w["look"].T + ds @ w["gate"].T) * (1 - h * h)
            slope = {
                "encode": x.T @ dh, "encode_0": dh.sum(axis=0), "look": h.T @ dt, "gate": h.T @ ds,
                "attend": (t * s).T @ de, "score": z.T @ d, "score_0": d.sum(keepdims=True),
            }
            for k in w:
                g = slope[k] + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, w)


def _is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> GatedAttention | None:
    """The classifier, fitted on labelled documents outside the held-out fold; None if these lack one of the labels.

    Of all such labels the train_docs with least id hash are taken, half of them at most of either
    label; of these, the shortest first, as many whole documents as have TRAIN_PASSAGES passages
    together, one of each label at least. Null labels and ids don't count, an id with both labels counts as 0, and of
    documents that share an id the one with the least text is read, null last.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .where(~_is_held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    picked = [rows.where(F.col("quality") == q).orderBy("h", "doc_id").limit(train_docs // 2) for q in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # train_docs rows at most
    chosen = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(sample, "doc_id")
        .groupBy("doc_id", "quality", "h")
        .agg(F.min("text").alias("text"))
        .withColumn("passages", F.greatest(F.lit(1), F.ceil(F.regexp_count("text", F.lit(WORD_PATTERN)) / PASSAGE)))
    )
    before = Window.partitionBy("quality").orderBy("passages", "h", "doc_id")  # train_docs rows at most
    whole = chosen.withColumns({"reached": F.sum("passages").over(before), "first": F.row_number().over(before)}).where((F.col("reached") <= TRAIN_PASSAGES // 2) | (F.col("first") == 1))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for part in slices(rows_of(batch, "text")):
                features, counts = passage_features(part)
                blobs += [one.astype(np.float32).tobytes() for one in np.split(features, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [rows_of(batch, "doc_id"), rows_of(batch, "quality"), pa.array(blobs, pa.binary())], ["doc_id", "quality", "x"]
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(*(rows_of(batch, c).to_pylist() for c in ("doc_id", "quality", "x")), strict=True)]
        if len({quality for _, quality, _ in found}) < 2:
            return
        found.sort(key=lambda row: row[0])
        arrays = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, _, x in found]
        model = GatedAttention.fit(np.concatenate(arrays), np.array([len(x) for x in arrays]), np.array([quality for _, quality, _ in found], float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the bounded sample is fitted in a task, so that the driver's memory holds the weights only
    described = whole.select("doc_id", "quality", "text").mapInArrow(describe, "doc_id long, quality int, x binary")
    models = described.repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(models[0].model) if models else None


def score_quality(docs: DataFrame, model: GatedAttention | None, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for each input row; with keep, the input row as the struct `row` instead of doc_id.

    All passages of the whole text are encoded. Null, empty and blank texts have one empty passage.
    Without a model every score is 1. Repeated rows score alike; extra columns are ignored; an
    empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            if shipped.value is None:
                yield pd.Series(np.ones(len(series)))
                continue
            column = pa.array(series, pa.string(), from_pandas=True)
            parts = [shipped.value.scores(*passage_features(p)) for p in slices(column)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    score = F.pandas_udf(score_all, "double")
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep else F.col("doc_id").cast("long").alias("doc_id")
    scored = docs.select(first, _is_held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
