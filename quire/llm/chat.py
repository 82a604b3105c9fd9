"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns that alternate, the user's first.
For each source turn the automaton may keep its role, relabel it or merge it into the turn before, and may put in
empty turns first; dynamic programming over its four states finds the cheapest repair. A turn is a 4 x 4 matrix
of costs, and matrices of consecutive turns multiply in the (min, +) semiring: so a conversation of more than
``LONG`` turns is cut into segments. The products give the costs with which the states are reached at each cut; from
these a segment takes the very steps that a pass over the whole conversation would take, ties included.

Turn markers in a text are kept from acting as such: one gets a backslash behind its "<" (``neutral``), and one that has
backslashes there gets one more, so ``restored`` gives the text back.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, written

#: Costs of one edit, and for equal sums a preference: merge before relabel before insert.
MERGE, RELABEL, INSERT = 1_001, 3_002, 2_003
#: Turns from which on a conversation is cut into segments.
LONG = 4096
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT, STATES = 0, 1, 2, 3, 4
#: What may follow each state, and states in which a conversation may end.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
END = (USER, ASSISTANT)
NO_WAY = 1 << 50
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


_MARKER = re.compile(r"<(\\*)\|(im_start|im_end)\|>")


def neutral(text: str) -> str:
    return _MARKER.sub(r"<\1\\|\2|>", text)


def restored(text: str) -> str:
    return re.sub(r"<\\(\\*)\|(im_start|im_end)\|>", r"<\1|\2|>", text)


@lru_cache(None)
def steps(role: str | None) -> list[list[tuple[int, tuple[int, ...], str]]]:
    """[from][to]: (cost, states of empty turns put in, action) of the cheapest way to take a turn of this role; unknown roles are always relabelled."""
    out = [[(NO_WAY, (), "")] * STATES for _ in range(STATES)]
    for a in range(STATES):
        ways = [((), a)]
        for _ in range(2):
            ways += [(put + (b,), b) for put, z in ways for b in NEXT[z] if len(put) < 2]
        for put, z in sorted(set(ways)):
            for b in range(1, STATES):
                own = 0 if role == ROLES[b - 1] else RELABEL
                done = [(own, "relabel" if own else "keep")] if b in NEXT[z] else []
                done += [(own + MERGE, "merge")] if b == z and not put else []
                for cost, action in done:
                    out[a][b] = min(out[a][b], (cost + INSERT * len(put), put, action))
    return out


@lru_cache(None)
def ending(a: int) -> tuple[int, tuple[int, ...]]:
    """(cost, states) of the empty turns after the last."""
    ways = [(), *((b,) for b in NEXT[a]), *((b, c) for b in NEXT[a] for c in NEXT[b])]
    return min((INSERT * len(w), w) for w in ways if ((a,) + w)[-1] in END)


@lru_cache(None)
def matrix(role: str | None) -> np.ndarray:
    return np.array([[x[0] for x in row] for row in steps(role)], np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NO_WAY)


#: Costs of the states before the first turn.
FRESH = tuple(0 if s == START else NO_WAY for s in range(STATES))


def _forward(roles: list[str | None], cost: tuple[int, ...] = FRESH) -> tuple[list[int], list[list[int]]]:
    """(costs of the states after the turns, for each turn the state from which each state is reached; the least of equal ones)."""
    cost, back = list(cost), []
    for role in roles:
        step = steps(role)
        came = [min((cost[a] + step[a][b][0], a) for a in range(STATES)) for b in range(STATES)]
        cost = [min(c, NO_WAY) for c, _ in came]
        back.append([a for _, a in came])
    return cost, back


def last_state(cost) -> int:
    """The state in which the cheapest repair ends."""
    return min(range(STATES), key=lambda b: (cost[b] + ending(b)[0], b))


def repair(roles: list[str | None], cost: tuple[int, ...] = FRESH, leave: int | None = None) -> list[tuple[int, int, tuple[int, ...], str]]:
    """(from, to, states put in, action) for each turn; leave: the last state, if it is given, else the cheapest with its ending."""
    after, back = _forward(roles, cost)
    state = last_state(after) if leave is None else leave
    path = []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        a = came[state]
        path.append((a, state, *steps(role)[a][state][1:]))
        state = a
    return path[::-1]


def pieces(path, texts: list[str | None], last: bool) -> list[tuple[str, str, list[str], str]]:
    """(role, action, roles of empty turns put in, rendered) for each turn; what is rendered joins to the whole conversation."""
    out = []
    for k, ((a, b, put, action), text) in enumerate(zip(path, map(neutral, (t or "" for t in texts)), strict=True)):
        put = [ROLES[s - 1] for s in put]
        if action == "merge":
            rendered = "\n" + text
        else:
            rendered = (CLOSE if a != START else "") + "".join(OPEN.format(r) + CLOSE for r in put) + OPEN.format(ROLES[b - 1]) + text
        if last and k == len(path) - 1:
            more = [ROLES[s - 1] for s in ending(b)[1]]
            rendered += CLOSE + "".join(OPEN.format(r) + CLOSE for r in more)
            put = put + more
        out.append((ROLES[b - 1], action, put, rendered))
    return out


_OUT = "new_role string, action string, inserted array<string>, rendered string"


def _groups(batches, n_keys: int):
    """Rows of one key (the first n_keys columns), which come together, as one table each."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True))
        at = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                if held and keys[at] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = keys[at]
                held.append(batch.slice(at, k - at))
                at = k
    if held:
        yield key, pa.Table.from_batches(held)


def _repaired(schema: pa.Schema):
    """A mapper over sorted rows (conv, seg, cost, leave, last, turn, role, text)."""

    def run(batches):
        cols, size = [[] for _ in range(7)], 0
        for (conv, _, cost, leave, last), rows in _groups(batches, 5):
            roles, texts = rows.column(6).to_pylist(), rows.column(7).to_pylist()
            got = pieces(repair(roles, tuple(np.frombuffer(cost, np.int64).tolist()), leave), texts, last)
            for col, values in zip(cols, ([conv] * len(roles), rows.column(5).to_pylist(), roles, *map(list, zip(*got, strict=True))), strict=True):
                col.extend(values)
            size += len(roles)
            if size >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                cols, size = [[] for _ in range(7)], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return released(run)


def _segment_row(rows, conv, seg, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([conv], rows.schema.field(0).type), pa.array([seg], pa.int32()), pa.array([raw], pa.binary())], names=["_conv", "_seg", "_m"])


def _products(batches):
    """(conv, seg, matrix) of each segment."""
    for (conv, seg), rows in _groups(batches, 2):
        m = np.where(np.eye(STATES, dtype=bool), 0, NO_WAY)
        for role in rows.column(3).to_pylist():
            m = times(m, matrix(role))
        yield _segment_row(rows, conv, seg, m.tobytes())


def _entries(batches):
    """(conv, seg, for each state in which the segment may be left the one in which it is entered), from rows (conv, seg, cost, role)."""
    for (conv, seg, cost), rows in _groups(batches, 3):
        at = list(range(STATES))
        for came in reversed(_forward(rows.column(3).to_pylist(), tuple(np.frombuffer(cost, np.int64).tolist()))[1]):
            at = [came[a] for a in at]
        yield _segment_row(rows, conv, seg, np.array(at, np.int64).tobytes())


def _costs(rows: pd.DataFrame) -> pd.DataFrame:
    """A conversation's segments in order: the costs with which each is entered, and those after the last."""
    rows = rows.sort_values("_seg")
    cost, out = np.array(FRESH, np.int64), []
    for raw in rows["_m"]:
        out.append(cost.tobytes())
        cost = np.minimum((cost[:, None] + np.frombuffer(raw, np.int64).reshape(STATES, STATES)).min(0), NO_WAY)
    end = [last_state(cost.tolist()) if k == len(out) - 1 else -1 for k in range(len(out))]
    return pd.DataFrame({"_conv": rows["_conv"].to_numpy(), "_seg": rows["_seg"].to_numpy(), "_cost": out, "_end": end})


def _leaves(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment is left, from the last one back."""
    rows = rows.sort_values("_seg", ascending=False)
    out, state = [], -1
    for raw, end in zip(rows["_m"], rows["_end"], strict=True):
        state = int(end) if end >= 0 else state
        out.append(state)
        state = int(np.frombuffer(raw, np.int64)[state])
    return pd.DataFrame({"_conv": rows["_conv"].to_numpy(), "_seg": rows["_seg"].to_numpy(), "_cost": rows["_cost"].to_numpy(), "_leave": out, "_last": (rows["_end"] >= 0).to_numpy()})


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG) -> DataFrame:
    """One row per source turn: conv, turn, role, new_role, action (keep, merge, relabel), inserted, rendered.

    A conversation's turns are taken by turn (nulls first), equal ones by a hash of role and text; repeated rows
    are turns of their own. Of repairs of equal cost, the one that comes from the lesser state at each turn, from the last
    one back, is taken, wherever a conversation of more than ``long`` turns is cut. ``inserted``: roles of the empty turns put in before the turn (for the last turn also
    after it). ``rendered`` pieces join, in that order, to the whole rendered conversation. A null role is an unknown
    one; a null text renders as empty; null conv is a conversation of its own. Turn markers in texts are rendered ``neutral``. Other columns are not read.
    """
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).cast("string").alias("_role"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_role", "_text"))
    kinds = {n: rows.schema[f"_{k}"].dataType.simpleString() for n, k in ((conv, "conv"), (turn, "turn"))}
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = f"_conv {kinds[conv]}, _turn {kinds[turn]}, role string, {_OUT}"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], out_schema).schema)
    fixed = ["_conv", "_seg", "_cost", "_leave", "_last"]
    fresh = F.lit(np.array(FRESH, np.int64).tobytes())
    whole = rows.withColumns({"_seg": F.lit(0), "_cost": fresh, "_leave": F.lit(None).cast("int"), "_last": F.lit(True)})

    def repaired(df):
        dealt = df.repartition("_conv", "_seg").sortWithinPartitions("_conv", "_seg", "_turn", "_tie")
        return dealt.select(*fixed, "_turn", "_role", "_text").mapInArrow(_repaired(schema), out_schema)

    big = written(rows.groupBy("_conv").count().where(F.col("count") > long).select(F.col("_conv").alias("_big")), "long")
    if big.isEmpty():
        out = repaired(whole)
    else:
        n = rows.count()
        same = F.col("_conv").eqNullSafe(F.col("_big"))
        cut = rows.join(big, same, "left_semi").repartitionByRange(max(1, 2 * n // long), "_conv", "_turn", "_tie", F.monotonically_increasing_id())
        cut = written(cut.withColumn("_seg", F.spark_partition_id()), "segments")
        dealt = cut.repartition("_conv", "_seg").sortWithinPartitions("_conv", "_seg", "_turn", "_tie")
        segment = f"_conv {kinds[conv]}, _seg int, _m binary"
        each = dealt.select("_conv", "_seg", "_turn", "_role").mapInArrow(released(_products), segment)
        met = lambda a, b: F.col(a).eqNullSafe(F.col(b)) & (F.col("_seg") == F.col("_s"))
        named = lambda df: df.withColumnsRenamed({"_conv": "_k", "_seg": "_s"})
        # one row a segment
        costs = written(each.groupBy("_conv").applyInPandas(_costs, f"_conv {kinds[conv]}, _seg int, _cost binary, _end int"), "costs")
        dealt = cut.join(named(costs.drop("_end")), met("_conv", "_k")).repartition("_conv", "_seg").sortWithinPartitions("_conv", "_seg", "_turn", "_tie")
        entries = dealt.select("_conv", "_seg", "_cost", "_role").mapInArrow(released(_entries), segment)
        entries = entries.join(named(costs), met("_conv", "_k")).drop("_k", "_s")
        ends = written(entries.groupBy("_conv").applyInPandas(_leaves, f"_conv {kinds[conv]}, _seg int, _cost binary, _leave int, _last boolean"), "ends")
        cut = cut.join(named(ends), met("_conv", "_k")).drop("_k", "_s")
        out = repaired(whole.join(big, same, "left_anti")).unionByName(repaired(cut))
    return out.select(F.col("_conv").alias(conv), F.col("_turn").alias(turn), F.col("role"), "new_role", "action", "inserted", "rendered")


def op4(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
