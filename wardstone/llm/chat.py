"""Chat formatting: the cheapest repair of role sequences, and rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, stored, table

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
MERGE, RELABEL, INSERT = 1, 2, 3
#: States are the last rendered role, or 0 before the first; a conversation ends with the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
#: Rows of a block; the repair of a longer conversation is put together from its blocks'.
BLOCK = 256


def steps(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """What a turn of this role (0: none of the three) may become: (from, to, cost, action, roles inserted before it)."""
    out = []
    for state in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            cost = 0 if to == role else RELABEL
            action = "keep" if to == role else "relabel"
            if to in NEXT[state]:
                out.append((state, to, cost, action, ()))
            if state == to:
                out.append((state, to, cost + MERGE, "merge" if to == role else "relabel+merge", ()))
            for first in NEXT[state]:
                if to in NEXT[first]:
                    out.append((state, to, cost + INSERT, action, (first,)))
                for second in NEXT[first]:
                    if to in NEXT[second]:
                        out.append((state, to, cost + 2 * INSERT, action, (first, second)))
    return out


_STEPS = [steps(r) for r in range(4)]
#: Empty turns that end a conversation from each state.
ENDINGS: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def block_costs(roles: list[int]) -> list[list[int]]:
    """Least cost from each state before the turns to each after them."""
    out = []
    for start in range(4):
        costs = [FAR] * 4
        costs[start] = 0
        for role in roles:
            new = [FAR] * 4
            for state, to, cost, *_ in _STEPS[role]:
                new[to] = min(new[to], costs[state] + cost)
            costs = new
        out.append(costs)
    return out


def repair(roles: list[int], start: int = START, end: int | None = None) -> tuple[int, list[tuple[int, int, str, tuple[int, ...]]]]:
    """Cost and, for each turn, (role, cost, action, inserted before) of the cheapest repair; ties to the step listed first.

    With end, the state to end in; otherwise the best one with its ending.
    """
    costs, backs = [FAR] * 4, []
    costs[start] = 0
    for role in roles:
        new, back = [FAR] * 4, [None] * 4
        for step in _STEPS[role]:
            state, to, cost = step[:3]
            if costs[state] + cost < new[to]:
                new[to], back[to] = costs[state] + cost, step
        costs = new
        backs.append(back)
    if end is None:
        end = min(range(4), key=lambda s: (costs[s] + INSERT * len(ENDINGS[s]), s))
    out, state = [], end
    for back in reversed(backs):
        step = back[state]
        out.append((step[1], step[2], step[3], step[4]))
        state = step[0]
    return costs[end], out[::-1]


def _role_number(role: Column) -> Column:
    name = F.lower(F.trim(role))
    known = F.create_map(*[F.lit(x) for k, v in ({r: r for r in ROLES} | ALIASES).items() for x in (k, v)])
    position = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.element_at(known, name))
    return F.coalesce(position, F.lit(0)).cast("int")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by key; a group may go on in the next batch."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*[rows_of(batch, c).to_pylist() for c in keys + columns], strict=True):
            key = row[: len(keys)]
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row[len(keys) :])
    if rows:
        yield current, rows


def format_chats(turns: DataFrame) -> DataFrame:
    """Repaired conversations: conv_id, turn, role, action, cost, rendered, a row for each input row.

    Legal are an optional system turn, then user and assistant in turn, the assistant last. Dynamic
    programming over this automaton finds for each conversation the cheapest mix of merging a
    turn into the one before (1), relabelling it (2) and inserting empty turns (3 each); ties
    go to the step listed first in steps(). `rendered` is the turn's part of the text, with the
    marks of turns inserted before it, and of those that end the conversation on its last row;
    the parts in order of turn are the whole conversation. `cost` is the row's own, endings
    included.

    Turns are ordered by turn (null first), then role and text (its first characters, then its
    hash), so ties and repeated rows have a place. Null or unknown roles cost a relabelling whatever
    they become; null texts count as empty. Rows with a null conv_id form one conversation. Extra
    columns are ignored; an empty table gives no rows.

    Rows are range-sorted and numbered, the number of a range's first row in its conversation being
    a sum over the ranges before it; so blocks have BLOCK rows, whatever turns are null, equal or
    repeated. Only roles decide, and costs of blocks compose: a block's 4 x 4 least costs, one pass
    over a conversation's blocks for the states between them, then the blocks on their own. So a
    conversation of any length is spread over tasks.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "said", "head", "h", "salt"]
    sorted_rows = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("said"),
            F.coalesce("text", F.lit("")).alias("text"),
            _role_number(F.col("role")).alias("role"),
        )
        .withColumns({"head": F.substring("text", 1, 64), "h": F.xxhash64("text"), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))})
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .select("conv_id", "turn", "text", "role", F.spark_partition_id().alias("range"), F.lit(0).cast("long").alias("place"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of each row among those of its range and conversation."""
        current, count = object(), 0
        for batch in batches:
            places = np.zeros(len(batch), np.int64)
            for i, conv in enumerate(rows_of(batch, "conv_id").to_pylist()):
                if conv != current:
                    current, count = conv, 0
                places[i] = count
                count += 1
            yield batch.set_column(batch.schema.get_field_index("place"), "place", pa.array(places))

    numbered = stored(sorted_rows.mapInArrow(place, sorted_rows.schema), "chat-turns")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = numbered.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("conv_id").alias("c"), F.col("range").alias("r"), F.sum("rows").over(earlier).alias("before")
    ).where("before > 0")
    begun = F.broadcast(begun)  # a row for each conversation that goes on in a range: one a range at most
    rows = numbered.join(begun, numbered.conv_id.eqNullSafe(F.col("c")) & (numbered.range == F.col("r")), "left").select(
        "conv_id", "turn", "text", "role", (F.col("place") + F.coalesce("before", F.lit(0))).alias("number")
    ).withColumn("block", F.floor(F.col("number") / BLOCK).cast("long"))
    order = ["conv_id", "block", "number"]

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), group in _groups(batches, ["conv_id", "block"], ["role"]):
            flat = [x for line in block_costs([r for (r,) in group]) for x in line]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], ["conv_id", "block", "costs"]
            )

    long_ones = rows.groupBy("conv_id").agg(F.max("block").alias("last")).where("last > 0").select("conv_id")
    long_ones = stored(long_ones, "long-chats")
    of_long = rows.join(long_ones, rows.conv_id.eqNullSafe(long_ones.conv_id), "left_semi")
    matrices = (
        of_long.select(*order, "role").repartition(n, "conv_id", "block").sortWithinPartitions(*order)
        .select("conv_id", "block", "role").mapInArrow(costs, "conv_id long, block long, costs array<long>")
    )

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in _groups(batches, ["conv_id"], ["block", "costs"]):
            reached, backs = [0, FAR, FAR, FAR], []
            for _, flat in group:
                best = [min((reached[s] + flat[4 * s + to], s) for s in range(4)) for to in range(4)]
                reached, back = [c for c, _ in best], [s for _, s in best]
                backs.append(back)
            end = min(range(4), key=lambda s: (reached[s] + INSERT * len(ENDINGS[s]), s))
            path = [end]
            for back in reversed(backs):
                path.append(back[path[-1]])
            path.reverse()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * len(group), pa.int64()), pa.array([b for b, _ in group], pa.int64()),
                    pa.array(path[:-1], pa.int32()), pa.array(path[1:], pa.int32()),
                    pa.array([i == len(group) - 1 for i in range(len(group))]),
                ],
                ["conv_id", "block", "enter", "leave", "last"],
            )

    between = stored(
        matrices.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
            states, "conv_id long, block long, enter int, leave int, last boolean"
        ),
        "chat-states",
    )
    placed = rows.join(
        between.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "enter", "leave", "last"),
        rows.conv_id.eqNullSafe(F.col("c")) & (rows.block == F.col("b")), "left",
    ).drop("c", "b")

    def mark(role: int) -> str:
        return f"<|{ROLES[role - 1]}|>\n"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn", "role", "action", "cost", "rendered"]
            )

        for (conv, _), group in _groups(batches, ["conv_id", "block"], ["turn", "text", "role", "enter", "leave", "last"]):
            enter, leave, last = group[0][3:]
            whole = enter is None
            _, plan = repair([g[2] for g in group], START if whole else enter, None if whole else leave)
            for i, ((turn, text, *_), (role, cost, action, inserted)) in enumerate(zip(group, plan, strict=True)):
                piece = "".join(f"{mark(r)}\n" for r in inserted)
                piece += f"{text}\n" if action.endswith("merge") else f"{mark(role)}{text}\n"
                if i == len(group) - 1 and (whole or last):
                    cost += INSERT * len(ENDINGS[role])
                    piece += "".join(f"{mark(r)}\n" for r in ENDINGS[role])
                out.append((conv, turn, ROLES[role - 1], action + "+insert" * bool(inserted), cost, piece))
            if len(out) >= 2000:
                yield flushed()
                out = []
        if out:
            yield flushed()

    return (
        placed.repartition(n, "conv_id", "block").sortWithinPartitions(*order)
        .select("conv_id", "block", "turn", "text", "role", "enter", "leave", "last")
        .mapInArrow(render, "conv_id long, turn long, role string, action string, cost long, rendered string")
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op8_chat_format": op8_chat_format}
SQL: dict[str, str] = {}
