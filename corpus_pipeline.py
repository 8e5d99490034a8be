"""From raw documents to a training mix: the operators of wardstone.llm as stages over documents.

Each stage reads what its predecessor kept and returns the columns of documents; the last
returns the mix. A stage's result is written before the next stage is called: run() writes it to
the shared folder, and the next stage deletes the scratch tables that it was made from.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm.common import owned, release, scratch_dir, table
from wardstone.llm.decontamination import contamination
from wardstone.llm.mixing import mix_sources
from wardstone.llm.ngram_join import id_column, one_of_each, row_id
from wardstone.llm.quality import fit_quality, score_quality
from wardstone.llm.repeats import remove_repeated_bytes


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Whose the scratch tables of a stage are; the next stage deletes them, and no others.
OWNER = "pipeline"


def staged(stage: Stage) -> Stage:
    """The stage, after the scratch tables of the stage before it are deleted."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER)
        with owned(OWNER):
            return stage(spark, docs, sf_dir)

    return run_stage


@staged
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the quality classifier, fitted on labelled ones of these, doesn't reject.

    Rows are judged one by one: repeated rows stay or go together, null and empty texts are scored
    as empty passages, and ids aren't looked at. With labels of one kind only, or none, all stay.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=True).where("predicted = 1").select("row.*")


@staged
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id, null last; of rows with equal doc_id and text one.

    Rows without words stand alone and stay. An empty table gives no rows.
    """
    return one_of_each(docs)


@staged
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the 50-byte strings that a row of a smaller doc_id holds; text and n_chars change, nothing else.

    Null texts stay null and a null doc_id is greater than all others. Rows that share a doc_id keep
    what they have in common. Where a cut splits a character its other bytes go too.
    """
    cut = remove_repeated_bytes(docs, with_text=True)
    changed = F.col("n_removed") > 0
    new = {
        "text": F.when(changed | F.col("had_text"), F.col("kept_text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@staged
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a benchmark item. Rows are judged by their own text, not by their doc_id; null texts stay."""
    name = id_column(docs)
    named = docs.withColumn(name, row_id())
    found = contamination(named.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return named.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").drop(name)


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of the sources by weight takes of each row; null sources are one source, texts without words are never taken, repeated rows count each."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: The classifier and the byte cuts have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{scratch_dir(spark)}/wardstone/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{path}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
