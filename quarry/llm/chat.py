"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant in turn,
ending with assistant. Dynamic programming over this automaton repairs a sequence of
turns at the lowest cost: a turn may be merged into the one before, given another
role, and empty turns may be inserted before it or at the end. The repaired sequence
is rendered with role markers.

A turn is a 4 x 4 table of costs between automaton states and tables compose, so a
conversation of any length is repaired in chunks of turn numbers: each chunk gives its
table, a small pass over the tables fixes the states in which chunks begin, and
each chunk is then repaired from its state. No conversation meets in one task.

A role marker inside a text is escaped, so that no text can forge a turn: ``<|`` becomes
``<\\|``, and ``<`` with backslashes and a bar gets one backslash more; ``unescaped``
takes one away again.

Defined cases: turns are ordered by turn, null turns first, then by a hash of role and
text; rows repeated in all of these count once; turns that aren't numbers are null; a
null or unknown role costs a relabel whatever it becomes; a null text is an empty one; a
null conv_id is a conversation; ids keep their type. Chunks of more than MOST rows (turn
numbers that repeat, or null ones) are cut into parts by turn and hash. Empty tables
give empty results. Equal costs: keeping before merging before relabelling, fewer inserted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, runs

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: After each state, the roles that may follow and the states they lead to.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, INSERT = 2, 1, 3
CHUNK = 256
MOST = 4096
PARTS = 1 << 30
FAR = 1 << 40


def _inserted(state: int, role: int) -> list[int] | None:
    """Fewest empty turns to insert so that role may follow state."""
    paths = [(state, [])]
    for _ in range(3):
        for at, done in paths:
            if role in NEXT[at]:
                return done
        paths = [(x, [*done, x]) for at, done in paths for x in NEXT[at] if x != SYSTEM]
    return None


GAPS = {(s, r): _inserted(s, r) for s in range(4) for r in (SYSTEM, USER, ASSISTANT)}


def moves(role: str | None) -> list[tuple[int, int, int, str, int, list[int]]]:
    """(cost, from, to, action, role it becomes, inserted roles), best first among equals."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for state in range(4):
        if state != START:
            out.append((MERGE + (RELABEL if own != state else 0), state, state, "merge", state, []))
        for r in (SYSTEM, USER, ASSISTANT):
            gap = GAPS[state, r]
            if gap is not None:
                out.append((INSERT * len(gap) + (RELABEL if own != r else 0), state, r, "keep" if own == r else "relabel", r, gap))
    rank = {"keep": 0, "merge": 1, "relabel": 2}
    return sorted(out, key=lambda m: (m[0], rank[m[3]], len(m[5]), m[4]))


MOVES = {r: moves(r) for r in (*ROLES, None)}


def _step(costs: Sequence[int], role: str | None) -> tuple[list[int], list]:
    """Costs of the four states after a turn, and the move that reached each."""
    new, by = [FAR] * 4, [None] * 4
    for m in MOVES[role if role in ROLES else None]:
        c = costs[m[1]] + m[0]
        if c < new[m[2]]:
            new[m[2]], by[m[2]] = c, m
    return new, by


def table(roles: Sequence[str | None]) -> list[list[int]]:
    """Lowest cost from each state to each state over the turns."""
    out = []
    for start in range(4):
        costs = [0 if s == start else FAR for s in range(4)]
        for r in roles:
            costs, _ = _step(costs, r)
        out.append(costs)
    return out


def path(roles: Sequence[str | None], start: int, end: int) -> list:
    """The moves of the best way from start to end."""
    costs, back = [0 if s == start else FAR for s in range(4)], []
    for r in roles:
        costs, by = _step(costs, r)
        back.append(by)
    out, state = [], end
    for by in reversed(back):
        out.append(by[state])
        state = by[state][1]
    return out[::-1]


def final_cost(state: int) -> int:
    """Cost of the turns to insert so that the conversation ends with assistant."""
    return 0 if state == ASSISTANT else INSERT * (len(GAPS[state, ASSISTANT]) + 1)


def repair(roles: Sequence[str | None], texts: Sequence[str | None], start: int, end: int, last: bool) -> tuple[list[tuple[str, str, bool]], dict[str, int]]:
    """Turns (role, text, continues) of the repaired chunk and counts of what was done; continues: the first turn goes on the one before the chunk."""
    out: list[list] = []
    done = {"merge": 0, "relabel": 0, "insert": 0, "cost": 0}
    for m, role, text in zip(path(roles, start, end), roles, texts, strict=True):
        cost, _, _, action, becomes, gap = m
        done["cost"] += cost
        done["merge"] += action == "merge"
        done["relabel"] += role != ROLES[becomes - 1]
        done["insert"] += len(gap)
        out += [[ROLES[g - 1], "", False] for g in gap]
        if action == "merge" and out:
            out[-1][1] += "\n" + (text or "")
        else:
            out.append([ROLES[becomes - 1], text or "", action == "merge"])
    if last and end != ASSISTANT:
        more = [*GAPS[end, ASSISTANT], ASSISTANT]
        out += [[ROLES[g - 1], "", False] for g in more]
        done["insert"] += len(more)
        done["cost"] += final_cost(end)
    return [tuple(x) for x in out], done


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: Sequence[tuple[str, str, bool]]) -> str:
    return "".join(f"\n{escaped(text)}" if goes_on else f"<|{role}|>\n{escaped(text)}" for role, text, goes_on in turns)


def _numbered(conversations: DataFrame, chunk: int, most: int) -> DataFrame:
    """Different turns with their chunk, a number that rises with the order of turns: chunks of turn numbers, and in large ones parts."""
    role = F.lower("role")
    named = conversations.select("conv_id", F.col("turn").try_cast("long").alias("turn"), role.alias("role"), "text").distinct().withColumn("tie", F.xxhash64("role", "text"))
    far = (1 << 32) - 1
    base = F.when(F.col("turn").isNull(), -far - 1).otherwise(F.greatest(F.lit(-far), F.least(F.lit(far), F.floor(F.col("turn") / chunk))))
    named = named.withColumn("chunk", base)
    large = named.groupBy("conv_id", "chunk").count().where(F.col("count") > most).select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), F.col("count").alias("_n"))
    # Parts are turns, and of each turn equal stretches of hashes.
    cuts = F.least(F.lit(PARTS // chunk), F.ceil(F.col("_n") / most))
    stretch = F.floor((F.shiftrightunsigned("tie", 33).bitwiseXOR(F.lit(1 << 30))) / F.lit(float(1 << 31)) * cuts)
    part = F.when(F.col("_n").isNull(), 0).otherwise(F.coalesce(F.pmod("turn", F.lit(chunk)), F.lit(0)) * cuts + stretch)
    met = named.join(large, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k")), "left")
    return met.withColumn("chunk", (F.col("chunk") * PARTS + part).cast("long")).drop("_c", "_k", "_n").withColumn("key", F.xxhash64("conv_id", "chunk"))


def format_chats(conversations: DataFrame, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """(conv_id, chunk, part, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, rendered), one row for each part of a chunk of a conversation.

    A conversation's rendering is that of its chunks and parts in order; few have more than one.
    """
    dealt = materialise(_sorted(_numbered(conversations, chunk, most)))
    kind = dict(dealt.dtypes)["conv_id"]

    def groups(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple]:
        conv, part, role, text = (rows.column(c).to_pylist() for c in ("conv_id", "chunk", "role", "text"))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            while a < b:  # keys of two groups may be equal
                e = a
                while e < b and (conv[e], part[e]) == (conv[a], part[a]):
                    e += 1
                yield conv[a], part[a], role[a:e], text[a:e]
                a = e

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in runs(batches, "key"):
            kinds = (rows.column("conv_id").type, pa.int64(), pa.list_(pa.int64()))
            found = [(c, p, np.ravel(table(r)).tolist()) for c, p, r, _ in groups(rows, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["conv_id", "chunk", "costs"])

    costs = materialise(_sorted(dealt).mapInArrow(tables, f"conv_id {kind}, chunk long, costs array<bigint>"))
    ends = materialise(_states(costs))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "chunk", "n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered")
        for rows, starts in runs(batches, "key"):
            cols = {c: rows.column(c).to_pylist() for c in ("conv_id", "chunk", "role", "text", "begin", "end", "last")}
            out: list[tuple] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                while a < b:
                    e = a
                    while e < b and (cols["conv_id"][e], cols["chunk"][e]) == (cols["conv_id"][a], cols["chunk"][a]):
                        e += 1
                    turns, done = repair(cols["role"][a:e], cols["text"][a:e], cols["begin"][a], cols["end"][a], cols["last"][a])
                    out.append((cols["conv_id"][a], cols["chunk"][a], e - a, sum(not t[2] for t in turns), done["merge"], done["relabel"], done["insert"], done["cost"], render(turns)))
                    a = e
            kinds = [rows.column("conv_id").type, *[pa.int64()] * 7, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    states = ends.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "begin", "end", "last")
    met = dealt.join(states, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")
    schema = f"conv_id {kind}, chunk long, n_turns long, n_out long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string"
    out = _sorted(met).mapInArrow(finished, schema)
    return out.withColumn("part", F.pmod("chunk", F.lit(PARTS))).withColumn("chunk", F.shiftright("chunk", 30))


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("key").sortWithinPartitions("key", "conv_id", "chunk", F.col("turn").asc_nulls_first(), "tie", "role", "text")


def _states(costs: DataFrame) -> DataFrame:
    """(conv_id, chunk, begin, end, last): the states between chunks on the best way through all chunks.

    Forward: the lowest cost of each state after each chunk, folded over the tables
    before; backward: the best state given the one after. One chunk in a conversation,
    the common case, needs no neighbours; of long conversations only tables come together.
    """
    counted, kind = costs.withColumn("n", F.count("*").over(W.partitionBy("conv_id"))), dict(costs.dtypes)["conv_id"]

    def best(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> list[tuple]:
            forward = [[0, FAR, FAR, FAR]]
            for _, _, t in held:
                f = forward[-1]
                forward.append([min(f[s] + t[4 * s + e] for s in range(4)) for e in range(4)])
            end = min(range(4), key=lambda s: (forward[-1][s] + final_cost(s), -s))
            out = []
            for k in range(len(held) - 1, -1, -1):
                c, p, t = held[k]
                begin = min(range(4), key=lambda s: (forward[k][s] + t[4 * s + end], s))  # noqa: B023
                out.append((c, p, begin, end, k == len(held) - 1))
                end = begin
            return out

        conv = None
        for batch in rows:
            conv = batch.column("conv_id").type
            out: list[tuple] = []
            for c, p, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "chunk", "costs")), strict=True):
                if held and held[0][0] != c:
                    out += solve()
                    held.clear()
                held.append((c, p, t))
            yield _state_rows(out, conv)
        if held:
            yield _state_rows(solve(), conv)

    single = F.col("n") == 1
    many = counted.where(~single).select("conv_id", "chunk", "costs").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(best, f"conv_id {kind}, chunk long, begin int, end int, last boolean")
    cost = lambda s: F.element_at("costs", s + 1) + F.lit(final_cost(s))
    least = F.least(*[F.struct(cost(s).alias("c"), F.lit(-s).alias("s")) for s in range(4)])
    ones = counted.where(single).select("conv_id", "chunk", F.lit(START).alias("begin"), (-least["s"]).cast("int").alias("end"), F.lit(True).alias("last"))
    return ones.unionByName(many)


def _state_rows(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = (conv, pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "chunk", "begin", "end", "last"])
