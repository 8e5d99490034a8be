"""Benchmark decontamination by spaced seeds. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Each mask keeps the token positions marked 1 and ignores the others.
MASKS = ("11111", "1101011", "11001011", "1110111")
#: A hit needs SHARE percent equal words in a run of WINDOW (of a shorter item: all) words.
WINDOW, SHARE = 20, 80
#: Items of fewer words have masks of their own, which lie at one place of them; up to WHOLE words all must be equal.
SHORT, WHOLE = 8, 4
#: Seeds that one broadcast holds, of 24 bytes each; more are searched in blocks.
BLOCK_SEEDS = 500_000


def _short_masks() -> list[tuple[int, int, str]]:
    """(words of the item, place, mask): all words, or from WHOLE + 1 words on all but one, as that many may differ."""
    out = [(n, 0, "1" * n) for n in range(1, WHOLE + 1)]
    for n in range(WHOLE + 1, SHORT):
        for gap in range(n):
            kept = "1" * gap + "0" + "1" * (n - gap - 1)
            out.append((n, int(gap == 0), kept.strip("0")))
    return out


def _words(text: str) -> Column:
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1)


def _seed(mask: str, words: str, at: Column) -> Column:
    """A hash of the words that a mask keeps at a position; null where the mask would pass the end."""
    kept = [F.get(words, at + o) for o, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *kept))


def contamination(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: int = SHARE
) -> DataFrame:
    """Documents that hold passages of benchmark items: doc_id, item_id, item_words, matched, window_matched.

    Words are lower-cased runs between white space. At every position of the whole text each
    mask gives a hash of the words it keeps; hashes equal to one of an item give an alignment of
    the item with the document. On each alignment the words are compared: the item counts as
    contained if some run of `window` words of it (all, if it has fewer) equals the document in
    `share` percent of places or more. So passages with substituted words are found as long as
    one mask falls between the substitutions; with the default masks that is so for all places of
    the substitutions in 8 to 20 words. Items of fewer than SHORT words are looked up by masks over
    all of their words, or all but one; those of up to WHOLE words must stand there unchanged.
    `matched` counts equal words of the best alignment, `window_matched` those of the best run.

    One row for each pair of doc_id and item_id; repeated rows and ids fold into it. Null texts
    and items without words match nothing; a null doc_id is reported as null. Very long texts and
    items are read whole. Empty tables give no rows; extra columns are ignored.

    The items' seeds, 24 bytes each, are broadcast in blocks of bounded size, so all positions are
    hashed and looked up in one generated pass over the text, and only alignments are shuffled.
    """
    items = stored(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")).alias("text"))
        .where(F.col("text") != "")
        .select("item_id", _words("text").alias("item"))
        .withColumn("item_key", F.xxhash64("item_id", "item"))
        .withColumn("n", F.size("item"))
        .dropDuplicates(["item_key"]),
        "items",
    )
    lengths = [r.n for r in items.where(F.col("n") < SHORT).select("n").distinct().collect()]  # SHORT rows at most
    short = [x for x in _short_masks() if x[0] in lengths]
    long_seeds = (
        items.where(F.col("n") >= SHORT)
        .select("item_key", "n", "item", F.posexplode("item").alias("item_at", "_w"))
        .select("item_key", "n", "item_at", F.explode(F.array(*[_seed(m, "item", F.col("item_at")) for m in masks])).alias("seed"))
    )
    short_seeds = [
        items.where(F.col("n") == n).select("item_key", "n", F.lit(at).alias("item_at"), _seed(mask, "item", F.lit(at)).alias("seed"))
        for n, at, mask in short
    ]
    seeds = stored(reduce(DataFrame.unionAll, short_seeds, long_seeds).where("seed is not null"), "seeds")
    n_blocks = max(1, -(-seeds.count() // BLOCK_SEEDS))
    placed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words("text").alias("words"))
        .select("doc_id", "words", F.posexplode("words").alias("at", "_w"))
        .select("doc_id", "words", "at", F.explode(F.array(*[_seed(m, "words", F.col("at")) for m in dict.fromkeys([*masks, *[m for _, _, m in short]])])).alias("seed"))
        .where("seed is not null")
    )

    def search(block: int) -> DataFrame:
        own = seeds.where(F.pmod(F.xxhash64("item_key", "item_at"), F.lit(n_blocks)) == block)
        hits = placed.join(F.broadcast(own), "seed")  # BLOCK_SEEDS rows, about
        # where all words are equal one alignment says as much as many
        shift = F.when(F.col("n") <= WHOLE, 0).otherwise(F.col("at") - F.col("item_at"))
        start = F.when(F.col("n") <= WHOLE, F.col("at")).otherwise(F.greatest(F.col("at") - F.col("item_at"), F.lit(0)))
        return hits.select(
            "doc_id", "item_key", shift.alias("shift"), F.slice("words", start + 1, F.col("n") + F.least(shift, F.lit(0))).alias("facing")
        )

    # stored, as the comparison's filter would else move into the join and end its generated code
    facing = stored(reduce(DataFrame.unionAll, [search(b) for b in range(n_blocks)]).distinct(), "alignments")
    before = F.least(F.col("shift"), F.lit(0))
    aligned = facing.join(items, "item_key").select(
        "doc_id", "item_id", "n",
        F.transform("item", lambda w, i: (F.get("facing", i + before) == w).cast("int")).alias("equal"),
    ).withColumn("equal", F.transform("equal", lambda x: F.coalesce(x, F.lit(0))))
    run = F.least(F.col("n"), F.lit(window))
    return (
        aligned.withColumn("matched", F.aggregate("equal", F.lit(0), lambda s, x: s + x))
        .withColumn("runs", F.transform(F.sequence(F.lit(1), F.col("n") - run + 1), lambda i: F.aggregate(F.slice("equal", i, run), F.lit(0), lambda s, x: s + x)))
        .withColumn("window_matched", F.array_max("runs"))
        .where(F.col("window_matched") * 100 >= run * share)
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("n").cast("long").alias("item_words"),
            F.max("matched").cast("long").alias("matched"),
            F.max("window_matched").cast("long").alias("window_matched"),
        )
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def contamination_sql(docs: str = "documents") -> str:
    """DuckDB SQL for contamination() over the relation docs and benchmark."""

    def laid(mask: str, relation: str, more: str = "true") -> str:
        kept = ", ".join(f"w[p + {o}]" for o, bit in enumerate(mask) if bit == "1")
        return f"SELECT *, '{mask}' AS mask, concat_ws(' ', {kept}) AS seed FROM {relation} WHERE p + {len(mask) - 1} <= len(w) AND {more}"

    short = _short_masks()
    of_items = [laid(m, "bp", f"len(w) >= {SHORT}") for m in MASKS] + [laid(m, "bp", f"len(w) = {n} AND p = {at + 1}") for n, at, m in short]
    of_docs = [laid(m, "dp", f"'{m}' IN (SELECT mask FROM bs)") for m in dict.fromkeys([*MASKS, *[m for _, _, m in short]])]
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs} WHERE text IS NOT NULL
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL
), dp AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), bp AS (
  SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM b
), bs AS ({' UNION ALL '.join(of_items)}), ds AS ({' UNION ALL '.join(of_docs)}
), hits AS (
  SELECT DISTINCT doc_id, item_id, ds.w AS dw, bs.w AS bw, ds.p - bs.p AS shift FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed
), flags AS (
  SELECT *, [CASE WHEN k + shift >= 1 AND k + shift <= len(dw) AND dw[k + shift] = bw[k] THEN 1 ELSE 0 END FOR k IN range(1, len(bw) + 1)] AS e,
    least(len(bw), {WINDOW}) AS run FROM hits
), counted AS (
  SELECT *, list_sum(e) AS matched,
    list_max([list_sum(e[i:i + run - 1]) FOR i IN range(1, len(bw) - run + 2)]) AS window_matched FROM flags
)
SELECT doc_id, item_id, max(len(bw))::BIGINT AS item_words, max(matched)::BIGINT AS matched, max(window_matched)::BIGINT AS window_matched
FROM counted WHERE window_matched * 100 >= run * {SHARE} GROUP BY doc_id, item_id
"""


QUERIES = {"op3_decontamination": op3_decontamination}
SQL = {"op3_decontamination": contamination_sql()}
