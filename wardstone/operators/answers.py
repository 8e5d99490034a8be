"""Checks of answers: figures, claims, protected text, secrets, egress, and attack reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import REDACTED, REFUSAL, block_flags, redact, redact_flags
from ..functions import views
from ..functions.text import claims, cosine, figures, has_markup, neutralise_markup, secret_core, strip, verdicts
from . import bloom
from .patterns import bounded, holding_any
from .tiles import BLOCK, column, matrix, tile_pairs, whole

# Fixed values.
RESEMBLANCE, ELEVATED, ELEVATED_COUNT, GROUNDING_FLOOR = 0.42, 0.32, 2, 0.30
LEAST_SECRET = 8
#: Rows and bytes of a registry that are broadcast; a larger one is joined by shuffle.
REGISTRY_ROWS, REGISTRY_BYTES = 1_000_000, 64 << 20
#: Characters of a text's piece that is cut into grams at once.
PIECE = 1000


def small(registry: DataFrame) -> DataFrame:
    """Broadcast a registry whose counted rows and bytes are bounded; leave the join to Spark else."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in registry.columns])))
    n, n_bytes = registry.limit(REGISTRY_ROWS + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(registry) if n <= REGISTRY_ROWS and (n_bytes or 0) <= REGISTRY_BYTES else registry


def unsupported_figures(answers: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """key, figures: sorted quantities of each answer that none of its documents state. answers: key, answer; evidence: key, text."""
    claimed = answers.select(key, F.explode(figures(F.col("answer"))).alias("figure"))
    stated = evidence.select(key, F.explode(figures(F.col("text"))).alias("figure"))
    return claimed.join(stated, [key, "figure"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("figure")).alias("figures"))


def unsupported_claims(answers: DataFrame, replies: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """key, n, claim for each claim without a SUPPORTED verdict. A missing verdict, reply or document counts against the claim.

    Of several replies the last by the column `at` counts; without one, and on ties, the greatest text.
    """
    numbered = answers.select(key, F.posexplode(claims(F.col("answer"))).alias("_p", "claim")).select(key, (F.col("_p") + 1).alias("n"), "claim")
    order = F.col("at") if "at" in replies.columns else F.lit(0)
    judged = replies.groupBy(key).agg(F.max(F.struct(order.alias("at"), "reply")).alias("last")).select(key, verdicts(F.col("last.reply")).alias("v"))
    has = evidence.select(key).distinct().withColumn("_has", F.lit(True))
    return (
        numbered.join(judged, key, "left").join(has, key, "left")
        .withColumn("verdict", F.when(F.col("_has"), F.coalesce(F.try_element_at("v", "n"), F.lit("UNSUPPORTED"))).otherwise("UNSUPPORTED"))
        .where("verdict = 'UNSUPPORTED'").select(key, "n", "claim")
    )


def _plain(text: str) -> tuple[bytes]:
    return (views.folded(text),)


def protected_matches(responses: DataFrame, protected: DataFrame, decoded: bool = True) -> DataFrame:
    """response_id of responses that share an 8-gram with protected text, as written or in a decoded variant.

    A Bloom filter of the registry's grams is tested before anything is exploded, so that only grams
    which may be protected become rows; they meet the registry as strings. A registry too large for
    the filter meets all grams by 64-bit hashes first, and as strings those of the responses that have such.
    """

    shown = views.with_decoded if decoded else _plain
    texts = dealt(responses.select("response_id", "text").where(F.col("text").isNotNull()), "response_id", "text")
    known = bloom.grams(protected, None, "text", views=_plain)
    held = bloom.filter_of(known)
    if held is not None:
        near = bloom.grams(texts, "response_id", "text", held=responses.sparkSession.sparkContext.broadcast(held), views=shown)
    else:
        every = bloom.grams(texts, "response_id", "text", views=shown, spell=False)
        met = every.join(known.select("h").distinct(), "h", "left_semi").select("response_id").distinct()
        near = bloom.grams(texts.join(met, "response_id", "left_semi"), "response_id", "text", views=shown)
    return near.join(small(known.select("gram").distinct()), "gram", "left_semi").select("response_id").distinct()


def registered_secrets(values: DataFrame) -> DataFrame:
    """Canonical cores of 8 characters and more. values: value."""
    return values.select(secret_core(F.col("value")).alias("core")).where(F.length("core") >= LEAST_SECRET).distinct()


def dealt(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows by the hash of their columns, so that costly work is spread however the input is split: a file of one row group is one task's."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def _cores(text: str) -> Iterator[str]:
    return (core.decode("ascii") for core in views.cores(text))


def _hay(texts: DataFrame) -> DataFrame:
    """response_id, hay: the cores of each text that are long enough to hold a secret."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = [core for core in _cores(text) if len(core) >= LEAST_SECRET]
                yield pa.RecordBatch.from_arrays([batch.column("response_id").take(pa.array([i] * len(found), pa.int64())), pa.array(found, pa.string())], ["response_id", "hay"])

    return texts.mapInArrow(cut, texts.select("response_id").schema.add("hay", "string"))


def secret_leaks(responses: DataFrame, secrets: DataFrame) -> DataFrame:
    """response_id of responses with a projection that contains a secret core. secrets: core, of LEAST_SECRET characters and more.

    A registry within patterns' bounds becomes an automaton, and each projection is read once. A larger
    one meets the projections by an equi-join on a core's first characters; only such pairs are compared whole.
    """
    folded = dealt(responses.select("response_id", "text").where(F.col("text").isNotNull()), "response_id", "text")
    held = bounded(secrets.where(F.length("core") >= LEAST_SECRET), "core")
    if held is not None:
        return holding_any(folded, held, "response_id", "text", _cores).distinct()
    hay = _hay(folded)
    pieces = hay.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("hay"), F.lit(PIECE)))).select(
        "response_id", "hay", F.substring("hay", F.col("start"), F.lit(PIECE + LEAST_SECRET - 1)).alias("piece")
    ).where(F.length("piece") >= LEAST_SECRET)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("piece") - LEAST_SECRET + 1), lambda i: F.substring(F.col("piece"), i, F.lit(LEAST_SECRET))))
    cores = small(secrets.select("core", F.substring("core", 1, LEAST_SECRET).alias("gram")))
    met = pieces.select("response_id", "hay", F.explode(grams).alias("gram")).join(cores, "gram")
    return met.where(F.contains(F.col("hay"), F.col("core"))).select("response_id").distinct()


def best_matches(vectors: DataFrame, references: DataFrame, name: str) -> DataFrame:
    """vectors (response_id, pos, embedding) with the largest cosine to a stated reference set (embedding).

    Vectors and references meet in tiles (tiles.tile_pairs), a matrix product a pair. Null vectors, and
    those of another size than a reference, never match it; of norm 0 they score 0.
    """
    v = F.col("embedding").cast("array<double>").alias("v")
    rows = vectors.select("response_id", "pos", v).where(whole(F.col("v")))
    known = references.select(v).where(whole(F.col("v"))).distinct()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m, known_m = matrix(batch, "c_m", i), matrix(batch, "q_m", i)
                each = max(1, BLOCK // len(known_m))
                best = np.concatenate([(m[j : j + each] @ known_m.T).max(axis=1) for j in range(0, len(m), each)])
                yield pa.RecordBatch.from_arrays([column(batch, "c_response_id", i), column(batch, "c_pos", i), pa.array(best)], ["response_id", "pos", name])

    scored = tile_pairs(known, rows).mapInArrow(score, rows.drop("v").schema.add(name, "double"))
    return scored.groupBy("response_id", "pos").agg(F.max(name).alias(name))


def resembles(scores: DataFrame) -> DataFrame:
    """response_id, resembles from window scores: one high window, or two elevated ones."""
    return scores.groupBy("response_id").agg(
        ((F.max("score") >= RESEMBLANCE) | (F.count_if(F.col("score") >= ELEVATED) >= ELEVATED_COUNT)).alias("resembles")
    )


def redact_ungrounded(scores: DataFrame) -> DataFrame:
    """response_id, text, replaced from scored sentences (response_id, pos, sentence, to_prompt, to_docs).

    A sentence nearer to protected text than to the documents gives way to a marker, in answers
    of two sentences and more of which one at least is grounded.
    """
    flagged = (F.col("to_prompt") >= GROUNDING_FLOOR) & (F.col("to_prompt") > F.col("to_docs"))
    grouped = scores.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sentence", flagged.alias("flagged")))).alias("s"),
        F.bool_or(F.col("to_docs") > F.col("to_prompt")).alias("grounded"),
        F.count_if(flagged).alias("n"),
    )
    on = F.col("grounded") & (F.size("s") >= 2) & (F.col("n") > 0)
    plain = F.array_join(F.transform("s", lambda x: x.sentence), "")
    cut = strip(F.array_join(F.transform("s", lambda x: F.when(x.flagged, F.lit(f" {REDACTED}")).otherwise(x.sentence)), ""))
    return grouped.select("response_id", F.when(on, cut).otherwise(plain).alias("text"), F.when(on, F.col("n")).otherwise(0).alias("replaced"))


def egress(responses: DataFrame, leaked: DataFrame | None = None, secret: DataFrame | None = None, paraphrased: DataFrame | None = None,
           ungrounded: DataFrame | None = None) -> DataFrame:
    """response_id, text, rules, blocked: block, redact, and defang markup last; a blocked row has the fixed refusal.

    leaked, secret and paraphrased name response_ids; ungrounded is redact_ungrounded()'s output.
    """
    out = responses.select("response_id", "text", block_flags(F.col("text")).alias("block"), redact_flags(F.col("text")).alias("masked"))

    def marked(df: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
        if ids is None:
            return df.withColumn(name, F.lit(False))
        return df.join(ids.select("response_id").distinct().withColumn(name, F.lit(True)), "response_id", "left").fillna(False, [name])

    out = marked(marked(marked(out, secret, "_secret"), leaked, "_leaked"), paraphrased, "_like")
    block = F.array_compact(F.concat("block", F.array(
        F.when(F.col("_secret"), "known_secret"),
        F.when(F.col("_leaked"), "hidden_context_leak").when(F.col("_like"), "hidden_context_paraphrase"),
    )))
    out = out.withColumn("block", block)
    if ungrounded is not None:
        out = out.join(ungrounded.select("response_id", F.col("text").alias("_cut"), "replaced"), "response_id", "left")
        cut = (F.coalesce("replaced", F.lit(0)) > 0) & (F.size("block") == 0)
        out = out.withColumn("text", F.when(cut, F.col("_cut")).otherwise(F.col("text"))).withColumn(
            "masked", F.when(cut, F.concat("masked", F.array(F.lit("ungrounded_sentence")))).otherwise(F.col("masked"))
        )
    safe = F.when(F.size("masked") > 0, redact(F.col("text"))).otherwise(F.col("text"))
    out = out.withColumn("safe", safe).withColumn("defanged", has_markup(F.col("safe")))
    blocked = F.size("block") > 0
    shown = F.when(blocked, REFUSAL).otherwise(neutralise_markup(F.col("safe")))
    rules = F.when(blocked, F.col("block")).otherwise(
        F.concat("masked", F.when(F.col("defanged"), F.array(F.lit("executable_markup"))).otherwise(F.array().cast("array<string>")))
    )
    return out.select("response_id", shown.alias("text"), rules.alias("rules"), blocked.alias("blocked"))


# ------------------------------------------------------------------ attack reports


def classify_runs(runs: DataFrame, lie: str, truth: str, poison: str) -> DataFrame:
    """runs (answer, sources) with verdict (POISON, both, truth, other) and in_context. lie and truth are patterns, poison a source."""
    p, t = F.col("answer").rlike(lie), F.col("answer").rlike(truth)
    verdict = F.when(p & t, "both").when(p, "POISON").when(t, "truth").otherwise("other")
    stem = poison.rsplit(".", 1)[0]
    seen = F.exists("sources", lambda s: F.contains(s, F.lit(stem)) | F.endswith(s, F.lit(poison)))
    return runs.withColumn("verdict", verdict).withColumn("in_context", F.coalesce(seen, F.lit(False)))


def outcome_rates(classified: DataFrame) -> DataFrame:
    """script, phase, tries, in_context, corrupted, truth."""
    return classified.groupBy("script", "phase").agg(
        F.count(F.lit(1)).alias("tries"), F.count_if("in_context").alias("in_context"),
        F.count_if(F.col("verdict").isin("POISON", "both")).alias("corrupted"), F.count_if(F.col("verdict") == "truth").alias("truth"),
    )


def before_after(rates: DataFrame, measure: str, phases: tuple[int, int] = (0, 1)) -> DataFrame:
    """script, before, after: one measure of two phases side by side."""
    wide = rates.groupBy("script").pivot("phase", list(phases)).agg(F.first(measure))
    return wide.select("script", F.col(str(phases[0])).alias("before"), F.col(str(phases[1])).alias("after"))


def over_clearance(answers: DataFrame, index: DataFrame, grants: DataFrame) -> DataFrame:
    """username, disclosures: answers' sources that lie in tiers the caller can't read. answers: answer_id, username, sources."""
    named = answers.select("answer_id", "username", F.explode("sources").alias("source"))
    placed = named.join(index.select("source", "tier").distinct(), "source")
    return placed.join(grants.select("username", "tier"), ["username", "tier"], "left_anti").groupBy("username").agg(
        F.count_distinct("answer_id", "source").alias("disclosures")
    )


def payload_grid(payloads: DataFrame, templates: DataFrame, size_limit: int = 10_000) -> DataFrame:
    """Every payload in every template (template with {payload}); the templates are a bounded set."""
    bounded = templates.limit(size_limit + 1)
    if bounded.count() > size_limit:
        raise ValueError(f"more than {size_limit} templates")
    return payloads.join(F.broadcast(templates), F.lit(True)).withColumn("text", F.replace("template", F.lit("{payload}"), F.col("payload")))


def canary_hits(results: DataFrame, poison: str) -> DataFrame:
    """results (answer, sources, canary) with valid (the poison source was retrieved) and hit (the canary is in a valid answer)."""
    valid: Column = F.coalesce(F.array_contains("sources", poison), F.lit(False))
    return results.withColumn("valid", valid).withColumn("hit", valid & F.coalesce(F.contains("answer", F.col("canary")), F.lit(False)))
