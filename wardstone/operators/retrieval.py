"""Scoped similarity retrieval: grants, top-k per trust class, screening, grounding, trust, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import REFUSAL, document_flags, injection_flags
from ..functions.text import cosine
from ..sources.corpus import CURATED, validate_query
from .tiles import BLOCK, column, matrix, tile_pairs, whole

# Fixed values.
TOP_K, MAX_DISTANCE = 4, 0.75
MIN_QUERY_RELEVANCE, MIN_CHUNK_RELEVANCE = 0.35, 0.30
HISTORY_TURNS, INTENT_MESSAGES, MAX_SESSIONS, MAX_TOOL_CALLS = 10, 6, 1000, 6


# ------------------------------------------------------------------ grants


def readable_tiers(principals: DataFrame, tiers: DataFrame) -> DataFrame:
    """username, tier, rank: the caller's own tier and all below it; an unknown clearance gives no row."""
    own = F.broadcast(tiers.select(F.col("tier").alias("clearance"), F.col("rank").alias("_own")))  # one row a tier
    below = F.broadcast(tiers.select("tier", "rank"))
    return principals.join(own, "clearance").join(below, F.col("rank") <= F.col("_own")).select("username", "tier", "rank")


def with_capability(requests: DataFrame, principals: DataFrame, role: str, grants: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) requests by username: exactly this role, and with grants only on a readable tier."""
    able = principals.where(F.col("role") == role).select("username")
    keys = ["username"]
    if grants is not None:
        able, keys = able.join(grants.select("username", "tier"), "username"), ["username", "tier"]
    return requests.join(able, keys, "left_semi"), requests.join(able, keys, "left_anti")


# ------------------------------------------------------------------ search


def is_curated(origin: Column) -> Column:
    return F.coalesce(origin, F.lit(CURATED)) == CURATED


def is_trusted(origin: Column, reviewed: Column) -> Column:
    """Curated or reviewed; a missing review is none."""
    return is_curated(origin) | reviewed.eqNullSafe(F.lit(True))


def nearest_chunks(
    questions: DataFrame, chunks: DataFrame, grants: DataFrame, k: int = TOP_K, per_class: bool = True, where: Column | None = None,
    but_own: bool = False, reviewed_budget: bool = False,
) -> DataFrame:
    """question_id, chunk_id, tier, origin, distance, place: the k nearest chunks of each question, by cosine distance.

    questions: question_id, username, embedding; chunks: chunk_id, tier, origin, embedding;
    grants: username, tier, rank. `where` filters chunks before the search, never after. per_class
    gives curated and other chunks a budget of k each, so that volume can't evict curated ones;
    with reviewed_budget reviewed foreign chunks (column reviewed) have one of their own too, so
    that unreviewed ones, which never answer, can't evict them.
    but_own leaves out, for each question, the chunk whose chunk_id is the question_id.
    Ties go to the lower tier, then to the lesser chunk_id; distances count to 12 decimals. Vectors
    of norm 0 have distance 1; null ones, those with null components, and those of another size
    than the question's never match.

    Questions and chunks meet in tiles (tiles.tile_pairs), a matrix product a pair. A task keeps the k
    best distances that it has found for each question and budget, and sends on only what comes near
    the worst of them; what tasks send is merged by question.
    """
    v = F.col("embedding").cast("array<double>").alias("v")
    rows = chunks if where is None else chunks.where(where)
    rows = rows.join(F.broadcast(grants.select("tier", "rank").distinct()), "tier")  # one row a tier
    budget = F.when(is_curated(F.col("origin")), 0).otherwise(1)
    if reviewed_budget:
        budget = F.when(~is_curated(F.col("origin")) & ~F.col("reviewed").eqNullSafe(F.lit(True)), 2).otherwise(budget)
    rows = rows.select("chunk_id", "tier", "rank", "origin", (budget if per_class else F.lit(0)).alias("budget"), v).where(whole(F.col("v")))
    ranks = F.aggregate(F.collect_set("rank"), F.lit(0), lambda s, r: s + F.pow(F.lit(2), r).cast("int"))  # a bit a tier
    allowed = grants.groupBy("username").agg(ranks.alias("ranks"))
    asked = questions.join(allowed, "username").select("question_id", "ranks", v).where(whole(F.col("v")))
    schema = "question_id long, chunk_id string, tier string, rank int, origin string, budget int, distance double"
    found = tile_pairs(asked, rows, ("rank", "chunk_id")).mapInArrow(_tile_search(k, but_own), schema)
    by = Window.partitionBy("question_id", "budget").orderBy("distance", "rank", "chunk_id")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


#: Question tiles whose best distances a task keeps.
KEPT_TILES = 256


def _tile_search(k: int, but_own: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each pair of tiles the rows that may be among the k nearest of a question and budget."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}  # by question tile: question, budget, the k least distances so far
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held = column(batch, "q_question_id", i).to_numpy(), column(batch, "q_ranks", i).to_numpy()
                unit, v = matrix(batch, "q_m", i), matrix(batch, "c_m", i)
                ranks, budget = column(batch, "c_rank", i).to_numpy(), column(batch, "c_budget", i).to_numpy()
                names = column(batch, "c_chunk_id", i)
                least = best.setdefault(ids.tobytes(), np.full((len(ids), 3, k), np.inf))
                at, question, distances = [], [], []
                for allowed in np.unique(held):
                    ok = allowed >> ranks & 1 > 0
                    asking = np.flatnonzero(held == allowed)
                    for b in np.unique(budget[ok]):
                        places = np.flatnonzero(ok & (budget == b))
                        near_v, near_names = v[places], names.take(pa.array(places))
                        n, each = min(k, len(places)), max(1, BLOCK // len(places))
                        for of in (asking[j : j + each] for j in range(0, len(asking), each)):
                            distance = near_v @ unit[of].T
                            np.round(np.subtract(1, distance, out=distance), 12, out=distance)
                            if but_own:
                                own = pc.index_in(near_names, pa.array(ids[of].astype(str).tolist(), pa.string())).to_numpy(zero_copy_only=False)
                                row = np.flatnonzero(~np.isnan(own.astype(float)))
                                distance[row, own[row].astype(int)] = np.inf
                            near = np.partition(distance, n - 1, axis=0)[:n].T
                            merged = np.sort(np.concatenate([least[of, b], near], 1), 1)[:, :k]
                            least[of, b] = merged
                            q, place = np.nonzero(((distance <= merged[:, -1]) & np.isfinite(distance)).T)
                            near = distance[place, q]
                            first = np.lexsort((place, near, q))  # a tile's rows stand in the order of ties
                            q, place, near = q[first], place[first], near[first]
                            on = np.arange(len(q)) - np.searchsorted(q, q) < k
                            at.append(places[place[on]])
                            question.append(of[q[on]])
                            distances.append(near[on])
                if len(best) > KEPT_TILES:
                    best.clear()
                if not at:
                    continue
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[np.concatenate(question)], pa.int64()), *[column(batch, f"c_{c}", i).take(take) for c in ("chunk_id", "tier", "rank", "origin", "budget")],
                     pa.array(np.concatenate(distances))],
                    ["question_id", "chunk_id", "tier", "rank", "origin", "budget", "distance"],
                )

    return search


# ------------------------------------------------------------------ after the search


def screen_hits(hits: DataFrame, secure: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits that match no rule, counts): per question retrieved, dropped and the distinct rule names in order."""
    flagged = hits.withColumn("rules", document_flags(F.coalesce("source", F.lit("")), F.col("text")))
    counts = flagged.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.count_if((F.size("rules") > 0) & F.lit(secure)).alias("dropped"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("flags"),
    )
    return (flagged.where(F.size("rules") == 0) if secure else flagged).drop("rules"), counts


def ground_hits(hits: DataFrame, max_distance: float = MAX_DISTANCE, secure: bool = True) -> DataFrame:
    """Hits near enough; a missing distance counts as 0."""
    return hits.where(F.coalesce("distance", F.lit(0.0)) <= max_distance) if secure else hits


def split_trusted(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): unreviewed foreign hits never answer, even alone."""
    ok = is_trusted(F.col("origin"), F.col("reviewed"))
    return hits.where(ok), hits.where(~ok)


def final_cut(hits: DataFrame, k: int = TOP_K, of: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """The first k that are left of each question, curated ones first."""
    by = Window.partitionBy(*of).orderBy((~is_curated(F.col("origin"))).cast("int"), "distance", "chunk_id")
    return hits.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def origin_counts(hits: DataFrame) -> DataFrame:
    """Per question: unverified (kept hits of foreign origin) and suppressed (untrusted ones)."""
    trusted = is_trusted(F.col("origin"), F.col("reviewed"))
    return hits.groupBy("question_id").agg(
        F.count_if(trusted & ~is_curated(F.col("origin"))).alias("unverified"), F.count_if(~trusted).alias("suppressed")
    )


def retrieve(
    questions: DataFrame, chunks: DataFrame, grants: DataFrame, k: int = TOP_K, max_distance: float = MAX_DISTANCE, secure: bool = True,
    but_own: bool = False,
) -> DataFrame:
    """Search, screen, ground, prefer trusted, cut, in this order: a screened hit is not replaced by the next neighbour.

    chunks also holds source, text and reviewed.
    """
    found = nearest_chunks(questions, chunks, grants, k, per_class=secure, but_own=but_own).drop("place", "budget", "rank")
    hits = found.join(chunks.select("chunk_id", "tier", "source", "text", "reviewed"), ["chunk_id", "tier"])
    if not secure:
        return final_cut(hits.withColumn("origin", F.coalesce("origin", F.lit(CURATED))), k)
    clean, _ = screen_hits(hits)
    kept, _ = split_trusted(ground_hits(clean, max_distance))
    return final_cut(kept, k)


def retrieve_phases(
    questions: DataFrame, chunks: DataFrame, grants: DataFrame, k: int = TOP_K, max_distance: float = MAX_DISTANCE, but_own: bool = False
) -> DataFrame:
    """retrieve() with and without its guards, as phases `secure` and `open` of one search.

    The k nearest of all lie among the k nearest of each class, so that one search and one screening
    serve both; a hit that both sides keep becomes two rows.
    """
    found = nearest_chunks(questions, chunks, grants, k, but_own=but_own).drop("place", "budget")
    overall = Window.partitionBy("question_id").orderBy("distance", "rank", "chunk_id")
    hits = found.withColumn("near", F.row_number().over(overall)).drop("rank").join(
        chunks.select("chunk_id", "tier", "source", "text", "reviewed"), ["chunk_id", "tier"]
    )
    clean = F.size(document_flags(F.coalesce("source", F.lit("")), F.col("text"))) == 0
    safe = clean & (F.coalesce("distance", F.lit(0.0)) <= max_distance) & is_trusted(F.col("origin"), F.col("reviewed"))
    phases = F.array_compact(F.array(F.when(F.col("near") <= k, "open"), F.when(safe, "secure")))
    split = hits.withColumn("phase", F.explode(phases)).drop("near")
    return final_cut(split.withColumn("origin", F.coalesce("origin", F.lit(CURATED))), k, ("question_id", "phase"))


def assemble_context(hits: DataFrame) -> DataFrame:
    """question_id, context: hits in order, each wrapped with its source as an escaped attribute."""
    escaped = F.coalesce("source", F.lit("unknown"))
    for char, entity in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    double, single = F.lit('"'), F.lit("'")
    quoted = F.when(~F.contains(escaped, double), F.concat(double, escaped, double)).when(
        ~F.contains(escaped, single), F.concat(single, escaped, single)
    ).otherwise(F.concat(double, F.replace(escaped, double, F.lit("&quot;")), double))
    piece = F.concat(F.lit("<document source="), quoted, F.lit(">\n"), F.col("text"), F.lit("\n</document>"))
    return hits.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))), lambda x: x.piece), "\n\n").alias("context")
    )


def result_sources(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (question_id, answer, blocked) with sources and uploaded_sources, both empty where blocked."""
    foreign = F.when(~is_curated(F.col("origin")), F.col("source"))
    found = hits.groupBy("question_id").agg(
        F.array_sort(F.collect_set("source")).alias("_sources"), F.array_sort(F.collect_set(foreign)).alias("_uploaded")
    )
    none = F.array().cast("array<string>")
    shown = lambda c: F.when(F.col("blocked"), none).otherwise(F.coalesce(c, none))
    return answers.join(found, "question_id", "left").select(
        *answers.columns, shown("_sources").alias("sources"), shown("_uploaded").alias("uploaded_sources")
    )


def uniform_refusal(answers: DataFrame) -> DataFrame:
    """The public view: one text for every refusal, and no rule names."""
    return answers.withColumn("answer", F.when(F.col("refused"), REFUSAL).otherwise(F.col("answer"))).withColumn(
        "flags", F.array().cast("array<string>")
    )


# ------------------------------------------------------------------ questions and conversations


def screen_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions to search, refusals). Invalid or flagged questions never reach the search. questions: question_id, question."""
    checked = validate_query(questions, "question").withColumn("flags", injection_flags(F.col("question")))
    blocked = F.col("violation").isNotNull() | (F.size("flags") > 0)
    refusals = checked.where(blocked).select("question_id", F.lit(REFUSAL).alias("answer"), F.lit(True).alias("refused"), "violation", "flags")
    return checked.where(~blocked).drop("violation", "flags"), refusals


def query_relevance(calls: DataFrame, least: float = MIN_QUERY_RELEVANCE) -> DataFrame:
    """calls (embedding, intent_embedding) with relevance and flag; no intent vector means fully relevant."""
    score = F.when(F.coalesce(F.size("intent_embedding"), F.lit(0)) <= 0, 1.0).otherwise(cosine(F.col("embedding"), F.col("intent_embedding")))
    return calls.withColumn("relevance", score).withColumn("flag", F.when(F.col("relevance") < least, "agent_off_topic_query"))


def chunk_relevance(hits: DataFrame, intents: DataFrame, least: float = MIN_CHUNK_RELEVANCE) -> tuple[DataFrame, DataFrame]:
    """(on topic, off topic) hits (question_id, embedding) against their question's intent_embedding, whatever query found them.

    Every hit is in one of the two. Without an intent vector, or with an empty one, a hit is fully
    relevant; a hit without a vector, or with one of another size or of norm 0, has relevance 0.
    """
    told = intents.select("question_id", "intent_embedding").dropDuplicates(["question_id"])
    score = F.when(F.coalesce(F.size("intent_embedding"), F.lit(0)) <= 0, 1.0).when(
        F.size("embedding") == F.size("intent_embedding"), cosine(F.col("embedding"), F.col("intent_embedding"))
    )
    scored = hits.join(told, "question_id", "left").withColumn("relevance", F.nanvl(F.coalesce(score, F.lit(0.0)), F.lit(0.0)))
    return scored.where(F.col("relevance") >= least), scored.where(F.col("relevance") < least).withColumn("flag", F.lit("agent_off_topic_chunk"))


def own_sessions(requests: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests of the session's owner, all others): absent and foreign sessions look alike. Keys: session_id, owner."""
    known = sessions.select("session_id", "owner").distinct()
    return requests.join(known, ["session_id", "owner"], "left_semi"), requests.join(known, ["session_id", "owner"], "left_anti")


def last_turns(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The newest n turns of each session, oldest first, as messages: session_id, pos, role, content."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n)
    oldest = Window.partitionBy("session_id").orderBy("turn", "half")
    halves = F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(1).alias("half"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    ))
    messages = kept.select("session_id", "turn", halves.alias("m")).select("session_id", "turn", "m.half", "m.role", "m.content")
    return messages.withColumn("pos", F.row_number().over(oldest)).select("session_id", "pos", "role", "content")


def intent_text(messages: DataFrame, n: int = INTENT_MESSAGES) -> DataFrame:
    """For each user message: what the user asked lately, the message itself last. messages: conv_id, turn, role, text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    earlier = F.collect_list(F.when((F.col("role") != "assistant") & (F.coalesce("text", F.lit("")) != ""), F.col("text"))).over(before)
    return messages.withColumn("intent", F.array_join(F.concat(earlier, F.array(F.coalesce("text", F.lit("")))), " ")).where("role = 'user'").select(
        "conv_id", "turn", "intent"
    )


def newest_sessions(sessions: DataFrame, n: int = MAX_SESSIONS) -> DataFrame:
    """The n sessions created last."""
    return sessions.orderBy(F.desc("created"), "session_id").limit(n)


def call_budget(calls: DataFrame, limit: int = MAX_TOOL_CALLS, least: float = MIN_QUERY_RELEVANCE) -> DataFrame:
    """calls (request_id, seq, tool, query, relevance) with decision and reason. Checks in order: tool, budget, arguments, rules, relevance.

    Only granted calls spend the budget. A call that the later checks refuse spends nothing, so
    the granted calls before a call are the passing ones before it, up to the limit.
    """
    checked = validate_query(calls.withColumn("_query", F.col("query")), "_query").withColumn(
        "_reason",
        F.when(F.col("violation").isNotNull(), "invalid_args")
        .when(F.size(injection_flags(F.col("_query"))) > 0, "screened")
        .when(F.coalesce("relevance", F.lit(1.0)) < least, "off_topic"),
    )
    known = F.coalesce(F.col("tool") == "retrieve", F.lit(False))
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum((known & F.col("_reason").isNull()).cast("int")).over(before), F.lit(0))
    reason = F.when(~known, "unknown_tool").when(spent >= limit, "budget_exhausted").otherwise(F.col("_reason"))
    return checked.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "allow").otherwise("deny")).select(
        *calls.columns, "decision", "reason"
    )
