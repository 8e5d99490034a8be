"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stored, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Shuffled documents of a source fall into this many runs (three hex digits), virtual times into this many ranges.
RUNS, RANGES = 4096, 16384


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Target of each source, from rows (src, source, size); one row per source in and out of the windows.

    Sources take the weights in order of code point, null last. The whole size is shared by
    weight; a source stops at max_copies times its own size and the rest is shared again.
    With sources ordered by the share at which they stop, source k is the first that doesn't
    stop when the level (total - what earlier ones hold) / (weights from k on) is at most its own.
    """
    per_source = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    everything = Window.partitionBy()
    by_share = Window.orderBy("full_at", "src")
    before = by_share.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_source.withColumn("weight", weight)
        .withColumn("full_at", (F.col("source_size") * max_copies).cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("held", F.coalesce(F.sum(F.col("source_size") * max_copies).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("held")).cast("double") / F.col("left_weight"))
        .withColumn("place", F.row_number().over(by_share))
        .withColumn("open_from", F.min(F.when(F.col("level") <= F.col("full_at"), F.col("place"))).over(everything))
        .withColumn("final_level", F.max(F.when(F.col("place") == F.col("open_from"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("place") < F.col("open_from"), (F.col("source_size") * max_copies).cast("double")).otherwise(
                F.col("final_level") * F.col("weight")
            ),
        )
        .select("src", "source_size", "target", "total")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix"
) -> DataFrame:
    """Give every document the words that a mix of total budget = all words takes of it.

    Input: doc_id, source, text; other columns are ignored, whatever their names. Output, a
    row for each input row: doc_id, size, source_size, target, taken.

    Documents of a source are shuffled by md5(seed, doc_id). Copy e (from 0) of a document has
    virtual finish time (e * source size + cumulative size) / target. All copies are ordered by
    it, and taken whole while their cumulative size stays within the budget, so each source ends
    within about one document of its target.

    Null text and text without words have size 0 and are never taken. Null sources form one
    source, null doc_ids are hashed as the empty id. Repeated rows are documents of their own;
    ties go by source, md5, doc_id, size and row. An empty table gives an empty result.

    No window holds a source whole: a source is cut into runs by the first md5 digits, a run's
    offset comes from the runs' sums; the same is done for ranges of the virtual time. The text
    is read once, and only ids and numbers are shuffled.
    """
    sizes = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        )
        .withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, max_copies)

    run = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    rows = sizes.withColumn("run", run)
    run_sums = rows.groupBy("src", "run").agg(F.sum("size").alias("run_size"))
    earlier_runs = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    run_starts = run_sums.select("src", "run", F.coalesce(F.sum("run_size").over(earlier_runs), F.lit(0)).alias("run_start"))
    in_run = Window.partitionBy("src", "run").orderBy("h", "doc_id", "size")
    placed = (
        rows.withColumn("row", F.row_number().over(in_run))
        .withColumn("cum_in_run", F.sum("size").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
        .join(run_starts, ["src", "run"])
        .join(targets, "src")
        .withColumn("cum", F.col("run_start") + F.col("cum_in_run"))
    )
    placed = stored(
        placed.select("src", "run", "row", "h", "doc_id", "size", "source_size", "target", "total", "cum"), "mix-placed"
    )

    copies = (
        placed.where((F.col("size") > 0) & (F.col("target") > 0))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
        .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("cum")).cast("double") / F.col("target"))
        .withColumn("range", F.floor(F.col("finish") / (F.col("finish") + 1) * RANGES).cast("int"))
    )
    range_sums = copies.groupBy("range").agg(F.sum("size").alias("range_size"))
    earlier_ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    range_starts = range_sums.select(
        "range", F.coalesce(F.sum("range_size").over(earlier_ranges), F.lit(0)).alias("range_start")
    )
    in_range = (
        Window.partitionBy("range")
        .orderBy("finish", "src", "h", "doc_id", "size", "row", "copy")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    taken = (
        copies.withColumn("cum_in_range", F.sum("size").over(in_range))
        .join(F.broadcast(range_starts), "range")  # RANGES rows at most
        .where(F.col("range_start") + F.col("cum_in_range") <= F.col("total"))
        .groupBy("src", "run", "row")
        .agg(F.sum("size").alias("taken"))
    )
    return placed.join(taken, ["src", "run", "row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def mix_sql(docs: str = "documents") -> str:
    """DuckDB SQL for mix_sources over the relation docs with its defaults."""
    return f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS h
  FROM {docs}
), per_source AS (
  SELECT src, source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY src, source
), weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM per_source
), levels AS (
  SELECT *, (source_size * 3)::DOUBLE / weight AS full_at, sum(source_size) OVER ()::BIGINT AS total FROM weighted
), shared AS (
  SELECT *, row_number() OVER o AS place,
    (total - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM levels WINDOW o AS (ORDER BY full_at, src)
), opened AS (
  SELECT *, min(CASE WHEN level <= full_at THEN place END) OVER () AS open_from FROM shared
), targets AS (
  SELECT src, source_size, total, CASE WHEN place < open_from THEN (source_size * 3)::DOUBLE
    ELSE max(CASE WHEN place = open_from THEN level END) OVER () * weight END AS target FROM opened
), placed AS (
  SELECT s.*, source_size, target, total, row_number() OVER w AS row_no,
    (sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum
  FROM sizes s JOIN targets USING (src) WINDOW w AS (PARTITION BY src ORDER BY h, doc_id, size)
), copies AS (
  SELECT *, (copy * source_size + cum)::DOUBLE / target AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0
), cut AS (
  SELECT src, row_no, size, total, sum(size) OVER (ORDER BY finish, src, h, doc_id, size, row_no, copy
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM copies
), taken AS (
  SELECT src, row_no, sum(size)::BIGINT AS taken FROM cut WHERE reached <= total GROUP BY src, row_no
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN taken USING (src, row_no)
"""


QUERIES = {"op10_mix_sources": op10_mix_sources}
SQL = {"op10_mix_sources": mix_sql()}
