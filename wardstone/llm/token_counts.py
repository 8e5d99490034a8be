"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, scratch_dir, table

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
LIMIT = 4096
#: Texts that one library call encodes.
CALL = 64

_loaded: dict[str, object] = {}


def tokenizer_digest(model: bytes, kind: str) -> str:
    """Identity of a tokenizer version: the library, its version and the model file."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if kind == "sentencepiece" else tokenizers.__version__
    return hashlib.sha256(f"{kind} {version} ".encode() + model).hexdigest()


def _encoder(model: bytes, kind: str, digest: str):
    """The counting function of this process; the model is loaded once."""
    if digest not in _loaded:
        if kind == "sentencepiece":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            _loaded[digest] = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[digest] = lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _loaded[digest]


def cached_counts(spark: SparkSession, cache_path: str) -> DataFrame:
    """Stored counts; a cache that doesn't exist yet is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, model: bytes, kind: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit, a row for each input row.

    Content is normalised by reading null as the empty text and taking UTF-8 bytes; nothing else
    is changed, as that would change counts. Its SHA-256 digest and that of the tokenizer version
    are joined to the cache at cache_path. Only distinct contents without a stored count are
    encoded, and their counts are appended to the cache, from which the result is read. Exact
    copies and reruns cost a join. Very long texts are encoded whole. Repeated rows and repeated
    or null doc_ids give a row each; extra columns are ignored; an empty table gives no rows.

    If a run ends between encoding and append, the next one encodes those texts again; two runs
    at once may store a digest twice, which the reading side folds.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(model, kind)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("content_digest", F.sha2(F.encode("text", "UTF-8"), 256))
    known = cached_counts(spark, cache_path).where(F.col("tokenizer_digest") == version)
    misses = (
        texts.select("content_digest", "text")
        .join(known.select("content_digest"), "content_digest", "left_anti")
        .dropDuplicates(["content_digest"])
    )
    shipped = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(shipped.value, kind, version)
        for batch in batches:
            column, digests = rows_of(batch, "text"), rows_of(batch, "content_digest")
            for at in range(0, len(column), CALL):
                part = column.slice(at, CALL).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [digests.slice(at, CALL), pa.array([version] * len(part)), pa.array(count(part), pa.int64())],
                    ["content_digest", "tokenizer_digest", "n_tokens"],
                )

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = (
        cached_counts(spark, cache_path)
        .where(F.col("tokenizer_digest") == version)
        .groupBy("content_digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return (
        texts.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "content_digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """Counts with a cache of this run's own, so that no run profits from an earlier one."""
    import public_tokenizers

    with open(public_tokenizers.path(tokenizer), "rb") as f:
        model = f.read()
    kind = "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"
    cache = f"{scratch_dir(spark)}/wardstone/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), model, kind, cache)


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
