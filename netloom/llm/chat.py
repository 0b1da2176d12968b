"""Chat formatting with minimum-cost role repair.

Legal conversations are read by an automaton: an optional system turn, then user and assistant in turns, an assistant turn
last. Each turn of the table is kept, relabelled, merged into the turn before it, or preceded by empty turns; empty turns
may also follow the last one. Dynamic programming over the automaton's four states finds the cheapest repair, and the
repaired sequence is rendered. Costs: relabel 2 (1 for an unknown role), merge 1, empty turn 3.

A conversation of any length is cut into blocks of turns. A block acts on the costs of the states as a min-plus matrix, so
a first pass over roles gives a matrix for each block, a scan over the few blocks of a conversation gives the costs at
which each block starts, and states at block ends follow backwards in the same way. The pieces of a conversation, in order of
``position``, joined without anything between them, are its rendering; no task ever holds a whole long conversation.

Defined results: roles are compared in lower case without outer white space, and usual synonyms count; null and other
roles are unknown. Null texts are empty turns. Turns go by number, null numbers last; equal numbers by a hash of role and
text. Rows with a null conv_id form one conversation. Of equally cheap repairs the one stands that, from the last turn
backwards, takes the state named first in ``STATES``. Marker strings inside a text are broken by a space, so a text cannot
open or close a turn. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .grouped import grouped

# Roles, their synonyms and the markers of the rendered form.
STATES = ("start", "system", "user", "assistant")
SYNONYMS = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "gpt": 3, "bot": 3, "model": 3, "ai": 3}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
RELABEL, UNKNOWN, MERGE, EMPTY = 2, 1, 1, 3
FAR = 1 << 40
BLOCK = 4096
KEYS = ["none", "conv", "part", "sub"]
FIRST = [0, FAR, FAR, FAR]


def _paths() -> dict[tuple[int, int], list[int]]:
    """Empty turns between two states on the shortest legal way."""
    out = {}
    for s in range(4):
        frontier, seen = [[s]], set()
        while frontier:
            following = []
            for path in frontier:
                for t in LEGAL[path[-1]]:
                    if t not in seen:
                        seen.add(t)
                        out[s, t] = path[1:]
                        following.append([*path, t])
            frontier = following
    return out


PATHS = _paths()
ENDS = [0 if s in (0, 3) else EMPTY * (1 + len(PATHS[s, 3])) for s in range(4)]


def _options() -> list[list[list[tuple[int, str, list[int]]]]]:
    """Cost, action and empty turns before, by role (0: unknown), state before and state after."""
    table = []
    for role in range(4):
        table.append([[(FAR, "", [])] * 4 for _ in range(4)])
        for s in range(4):
            for t in (1, 2, 3):
                label = 0 if role == t else RELABEL if role else UNKNOWN
                name = "" if role == t else "relabel"
                choices = [(label + EMPTY * len(PATHS[s, t]), name or "keep", PATHS[s, t])] if (s, t) in PATHS else []
                if s == t:
                    choices.append((label + MERGE, "merge" + (f" and {name}" if name else ""), []))
                if choices:
                    table[role][s][t] = min(choices, key=lambda c: c[0])
    return table


OPTIONS = _options()
COSTS = np.array([[[OPTIONS[r][s][t][0] for t in range(4)] for s in range(4)] for r in range(4)], np.int64)


def role_number(role: str | None) -> int:
    return SYNONYMS.get((role or "").strip().lower(), 0)


def forward(start: list[int], roles: list[int]) -> list[list[int]]:
    """Cheapest cost of each state before every turn and after the last."""
    out = [list(start)]
    for r in roles:
        out.append([int(x) for x in np.minimum((np.array(out[-1])[:, None] + COSTS[r]).min(axis=0), FAR)])
    return out


def backward(costs: list[list[int]], roles: list[int], end: int) -> list[int]:
    """States before each turn and after the last on the chosen way that ends in ``end``."""
    states = [end]
    for k in range(len(roles) - 1, -1, -1):
        way = np.array(costs[k]) + COSTS[roles[k]][:, states[-1]]
        states.append(int(way.argmin()))
    return states[::-1]


def final_state(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + ENDS[s], s))


def _matrix(roles: list[int]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = np.minimum((m[:, :, None] + COSTS[r][None, :, :]).min(axis=1), FAR)
    return m


def repair(roles: list[str | None]) -> tuple[int, list[int]]:
    """Cost and states of a whole conversation."""
    numbers = [role_number(r) for r in roles]
    costs = forward(FIRST, numbers)
    end = final_state(costs[-1])
    return costs[-1][end] + ENDS[end], backward(costs, numbers, end)


def _turn(role: int, text: str) -> str:
    return f"{OPEN}{STATES[role]}\n{text}"


def pieces(roles: list[int], texts: list[str | None], states: list[int], last: bool) -> list[tuple[str, str, int, int, str]]:
    """New role, action, number of empty turns, cost and rendered piece of each turn of a block."""
    out = []
    for k, (role, text) in enumerate(zip(roles, texts)):
        s, t = states[k], states[k + 1]
        cost, action, empty = OPTIONS[role][s][t]
        text = (text or "").replace("<|", "< |")
        if action.startswith("merge"):
            piece = f"\n\n{text}"
        else:
            piece = (f"{CLOSE}\n" if s else "") + "".join(f"{_turn(e, '')}{CLOSE}\n" for e in empty) + _turn(t, text)
        empties = len(empty)
        if last and k == len(roles) - 1:
            tail = [*PATHS[t, 3], 3] if ENDS[t] else []
            piece += f"{CLOSE}\n" + "".join(f"{_turn(e, '')}{CLOSE}\n" for e in tail)
            empties, cost = empties + len(tail), cost + ENDS[t]
        out.append((STATES[t], action, empties, cost, piece))
    return out


def _placed(turns: DataFrame, block: int) -> DataFrame:
    """Turns with their block: numbers in ranges; only a range with far too many rows is cut by number and hash."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"conv_id must be a whole number, not {kind}")
    number = F.col("turn").cast("bigint")
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv"), number.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.select(
        F.col("conv").isNull().cast("int").alias("none"), F.coalesce("conv", F.lit(0)).alias("conv"), F.coalesce("turn", F.lit(2**63 - 1)).alias("order"),
        F.xxhash64("role", "text").alias("tie"), "turn", "role", "text")
    rows = rows.withColumn("part", F.expr(f"`order` div {block}L") - (F.col("order") % F.lit(block) < 0).cast("bigint"))
    # A row for each 4 x block turns at most, most often none.
    crowded = cut_lineage(rows.groupBy("none", "conv", "part").count().where(F.col("count") > 4 * block).select(
        "none", "conv", "part", F.least(F.lit(40), F.length(F.bin(F.expr(f"count div {block}L")))).alias("bits")))
    if crowded.isEmpty():
        return rows.withColumn("sub", F.lit(0).cast("bigint"))
    sub = F.expr(f"pmod(`order`, {block}L) * shiftleft(1L, bits) + shiftright(tie, 64 - bits)")  # in the order of (order, tie)
    return rows.join(crowded, ["none", "conv", "part"], "left").withColumn("sub", F.coalesce(sub, F.lit(0).cast("bigint"))).drop("bits")


def _sorted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _head(table: pa.Table, keys: list[str]) -> list[int]:
    return [table.column(k)[0].as_py() for k in keys]


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def _batched(made: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in made:
        held.append(row)
        if len(held) >= size:
            yield _rows(held, schema)
            held = []
    if held:
        yield _rows(held, schema)


KEY_FIELDS = [pa.field("none", pa.int32()), *(pa.field(k, pa.int64()) for k in KEYS[1:])]
KEY_DDL = "none int, conv bigint, part bigint, sub bigint"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*KEY_FIELDS, pa.field("n", pa.int64()), pa.field("matrix", pa.list_(pa.int64()))])

    def made():
        for t in grouped(batches, KEYS):
            roles = [role_number(r) for r in t.column("role").to_pylist()]
            yield *_head(t, KEYS), len(roles), _matrix(roles).ravel().tolist()

    return _batched(made(), schema)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs at the start of each block, its first position, and for the last block of a conversation its end state."""
    schema = pa.schema([*KEY_FIELDS, pa.field("first", pa.int64()), pa.field("start", pa.list_(pa.int64())), pa.field("end", pa.int32()), pa.field("blocks", pa.int64())])

    def made():
        for t in grouped(batches, ["none", "conv"]):
            costs, first = list(FIRST), 0
            matrices, n = t.column("matrix").to_pylist(), t.column("n").to_pylist()
            keys = list(zip(*(t.column(k).to_pylist() for k in KEYS)))
            for k, key in enumerate(keys):
                start = costs
                costs = [int(x) for x in np.minimum((np.array(start)[:, None] + np.array(matrices[k]).reshape(4, 4)).min(axis=0), FAR)]
                yield *key, first, start, final_state(costs) if k == len(keys) - 1 else None, len(keys)
                first += n[k]

    return _batched(made(), schema)


def _back_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each end state of a block the state in which it then starts."""
    schema = pa.schema([*KEY_FIELDS, pa.field("back", pa.list_(pa.int32()))])

    def made():
        for t in grouped(batches, KEYS):
            roles = [role_number(r) for r in t.column("role").to_pylist()]
            costs = forward(t.column("start")[0].as_py(), roles)
            yield *_head(t, KEYS), [backward(costs, roles, e)[0] for e in range(4)]

    return _batched(made(), schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*KEY_FIELDS, pa.field("end", pa.int32())])

    def made():
        for t in grouped(batches, ["none", "conv"]):
            keys = list(zip(*(t.column(k).to_pylist() for k in KEYS)))
            back, end = t.column("back").to_pylist(), t.column("end").to_pylist()
            state = end[-1]
            for k in range(len(keys) - 1, -1, -1):
                yield *keys[k], state
                state = back[k][state]

    return _batched(made(), schema)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        pa.field("conv_id", pa.int64()), pa.field("position", pa.int64()), pa.field("turn", pa.int64()), pa.field("role", pa.string()), pa.field("new_role", pa.string()),
        pa.field("action", pa.string()), pa.field("n_empty", pa.int64()), pa.field("cost", pa.int64()), pa.field("piece", pa.string())])

    def made():
        for t in grouped(batches, KEYS):
            none, conv, _, _ = _head(t, KEYS)
            names, texts, turns = (t.column(c).to_pylist() for c in ("role", "text", "turn"))
            roles = [role_number(r) for r in names]
            states = backward(forward(t.column("start")[0].as_py(), roles), roles, t.column("end")[0].as_py())
            first = t.column("first")[0].as_py()
            for k, piece in enumerate(pieces(roles, texts, states, t.column("last")[0].as_py())):
                yield None if none else conv, first + k, turns[k], names[k], *piece

    return _batched(made(), schema)


def formatted(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, position, turn, role, new_role, action, n_empty, cost, piece: one row for each turn."""
    rows = _placed(turns, block)
    order = ["order", "tie"]
    roles = _sorted(rows.select(*KEYS, *order, "role"), KEYS, order)
    blocks = cut_lineage(roles.mapInArrow(_matrices, f"{KEY_DDL}, n bigint, matrix array<bigint>"))
    starts = cut_lineage(blocks.repartition("none", "conv").sortWithinPartitions(*KEYS).mapInArrow(
        _starts, f"{KEY_DDL}, first bigint, start array<bigint>, end int, blocks bigint"))
    several = starts.where("blocks > 1")
    back = _sorted(rows.select(*KEYS, *order, "role").join(several.select(*KEYS, "start"), KEYS), KEYS, order).mapInArrow(_back_maps, f"{KEY_DDL}, back array<int>")
    ends = (several.select(*KEYS, "end").join(back, KEYS).repartition("none", "conv").sortWithinPartitions(*KEYS).mapInArrow(_ends, f"{KEY_DDL}, end int"))
    known = starts.select(*KEYS, "first", "start", F.col("end").alias("own"), F.col("end").isNotNull().alias("last"))
    known = known.join(ends, KEYS, "left").select(*KEYS, "first", "start", F.coalesce("own", "end").alias("end"), "last")
    return _sorted(rows.join(known, KEYS), KEYS, order).mapInArrow(
        _rendered, "conv_id bigint, position bigint, turn bigint, role string, new_role string, action string, n_empty bigint, cost bigint, piece string")
