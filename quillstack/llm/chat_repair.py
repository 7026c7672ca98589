"""Chat formatting with minimum-cost role repair.

Legal conversations: an optional system turn, then user and assistant turns in
alternation, ending with an assistant's.  For every given turn the repair keeps
its role, relabels it, merges it into the turn before, or puts empty turns in
front; a dynamic program over the automaton's states picks the cheapest way.

A turn is a 4 x 4 matrix of costs (state before, state after), and matrices
combine by (min, +), so a conversation can be cut anywhere: rows are dealt out
by range and cut into chunks of ``CHUNK``; chunks give the matrices of the
conversations at their edges, a short pass per conversation fixes the states
at the cuts, and every chunk then traces its own turns.  A conversation with a
third of all rows is many chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which states may follow each state, in the order that ties prefer.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
CHUNK = 4096
FAR = 1 << 40


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of empty turns that makes a turn of state t legal after state s."""
    out = {}
    for s in NEXT:
        work = [(s, ())]
        while work:
            at, path = work.pop(0)
            for t in NEXT[at]:
                if (s, t) not in out:
                    out[s, t] = path
                    work.append((t, (*path, t)))
    return out


INSERTS = _inserts()
#: Empty turns that end a conversation, by its last state.
ENDINGS = {s: () if s == ASSISTANT else (*INSERTS[s, ASSISTANT], ASSISTANT) for s in NEXT}


def step(state: int, role: int, target: int) -> tuple[int, tuple[int, ...], bool]:
    """Cost, empty turns and whether it merges, for rendering a turn of role as target after state."""
    relabel = RELABEL * (role != target)
    ways = []
    if state == target and state != START:
        ways.append((relabel + MERGE, (), True))
    if (state, target) in INSERTS:
        path = INSERTS[state, target]
        ways.append((relabel + INSERT * len(path), path, False))
    return min(ways, key=lambda w: (w[0], not w[2])) if ways else (FAR, (), False)


def _matrix(role: int) -> np.ndarray:
    return np.array([[FAR if t == START else step(s, role, t)[0] for t in range(4)] for s in range(4)], np.int64)


MATRICES = np.stack([_matrix(r) for r in (0, SYSTEM, USER, ASSISTANT)])  # 0: a role of no known name
END_COST = np.array([INSERT * len(ENDINGS[s]) for s in range(4)], np.int64)


def _role_numbers(roles: list[str | None]) -> np.ndarray:
    known = {r: i + 1 for i, r in enumerate(ROLES)}
    return np.array([known.get((r or "").strip().lower(), 0) for r in roles], np.int64)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def trace(roles: np.ndarray, first: int, last: int | None) -> list[int]:
    """The cheapest states after each turn, from state first to state last (None: wherever it ends cheapest)."""
    best = np.full(4, FAR, np.int64)
    best[first] = 0
    back = []
    for r in roles:
        cost = best[:, None] + MATRICES[r]
        back.append(cost.argmin(0))
        best = np.minimum(cost.min(0), FAR)
    at = int((best + END_COST).argmin()) if last is None else last
    out = []
    for b in reversed(back):
        out.append(at)
        at = int(b[at])
    return out[::-1]


def _numbered(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            at = np.arange(pos, pos + n)
            pos += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array((at // chunk).astype(np.int32)), pa.array(at), *b.columns], ["part", "chunk", "pos", "conv_id", "turn", "role", "text"])

    return run


def _runs(conv: list) -> list[tuple[int, int]]:
    cuts = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]] + [len(conv)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _edges(t: pa.Table) -> pa.Table:
    """A chunk's conversations that may go on beyond it, with their matrices."""
    t = t.sort_by("pos")
    conv, roles = t["conv_id"].to_pylist(), _role_numbers(t["role"].to_pylist())
    runs = _runs(conv)
    out = []
    for a, z in runs[:1] + runs[1:][-1:]:
        m = MATRICES[roles[a]]
        for r in roles[a + 1 : z]:
            m = combine(m, MATRICES[r])
        out.append((t["part"][0].as_py(), t["chunk"][0].as_py(), t["pos"][a].as_py(), conv[a], m.tobytes()))
    cols = list(zip(*out, strict=True))
    return pa.table({"part": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "pos": pa.array(cols[2], pa.int64()), "conv_id": pa.array(cols[3], pa.int64()), "costs": pa.array(cols[4], pa.binary())})


def _cuts(t: pa.Table) -> pa.Table:
    """One conversation's pieces in order: the states before and after each on the cheapest way."""
    t = t.sort_by([("part", "ascending"), ("pos", "ascending")])
    steps = [np.frombuffer(c, np.int64).reshape(4, 4) for c in t["costs"].to_pylist()]
    best = np.full(4, FAR, np.int64)
    best[START] = 0
    back = []
    for m in steps:
        cost = best[:, None] + m
        back.append(cost.argmin(0))
        best = np.minimum(cost.min(0), FAR)
    at = int((best + END_COST).argmin())
    before, after = [], []
    for b in reversed(back):
        after.append(at)
        at = int(b[at])
        before.append(at)
    n = len(steps)
    return pa.table({"part": t["part"], "chunk": t["chunk"], "pos": t["pos"], "before": pa.array(before[::-1], pa.int32()), "after": pa.array(after[::-1], pa.int32()), "opens": pa.array([i == 0 for i in range(n)]), "ends": pa.array([i == n - 1 for i in range(n)])})


OUT = "conv_id long, turn long, place long, action string, role string, given_role string, cost long, text string, rendered string"


def _render(turns: pa.Table, cuts: pa.Table) -> pa.Table:
    t = turns.sort_by("pos")
    conv, turn, given, text = (t[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))
    part, pos = t["part"].to_pylist(), t["pos"].to_pylist()
    roles = _role_numbers(given)
    fixed = {p: (b, a, o, e) for p, b, a, o, e in zip(*(cuts[c].to_pylist() for c in ("pos", "before", "after", "opens", "ends")), strict=True)}
    out: list[tuple] = []
    for a, z in _runs(conv):
        before, after, opens, ends = fixed.get(pos[a], (START, None, True, True))
        state = before
        for i, target in zip(range(a, z), trace(roles[a:z], before, after), strict=True):
            cost, path, merged = step(state, int(roles[i]), target)
            place = (part[i] << 44) + (pos[i] << 3)
            for k, r in enumerate(path):
                out.append((conv[i], None, place + k, "insert", ROLES[r - 1], None, INSERT, "", _open(r, state == START and k == 0 and opens and i == a)))
            verb = "merge" if merged else "keep" if roles[i] == target else "relabel"
            body = text[i] or ""
            own = cost - INSERT * len(path)
            head = "\n\n" if merged else _open(target, state == START and not path)
            out.append((conv[i], turn[i], place + len(path), verb, ROLES[target - 1], given[i], own, body, head + body))
            state = target
        if ends:
            for k, r in enumerate(ENDINGS[state]):
                out.append((conv[a], None, place + 4 + k, "insert", ROLES[r - 1], None, INSERT, "", _open(r, False)))
            last = out[-1]
            out[-1] = (*last[:-1], last[-1] + "<|end|>\n")
    cols = list(zip(*out, strict=True)) if out else [()] * 9
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(OUT.split(", "), cols, kinds, strict=True)})


def _open(state: int, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{ROLES[state - 1]}|>\n"


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The repaired turns: conv_id, turn (null for inserted ones), place, action, role, given_role, cost, text, rendered.

    In order of place, a conversation's ``rendered`` strings put together are its
    text.  Ties go to merging, then to the earlier state.  Unknown and null roles
    cost a relabel whatever they become.  Null turns come last, repeated turn
    numbers in order of role and text; a null conv_id is a conversation; null
    texts are empty.  An empty table gives no turns; other columns are not read.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    sorted_rows = rows.repartitionByRange(parts, *keys[:4]).sortWithinPartitions(*keys)
    turns = scratch.save(sorted_rows.mapInArrow(_numbered(chunk), "part int, chunk int, pos long, conv_id long, turn long, role string, text string"), "turns")
    edges = turns.select("part", "chunk", "pos", "conv_id", "role").groupBy("part", "chunk").applyInArrow(_edges, "part int, chunk int, pos long, conv_id long, costs binary")
    cuts = edges.groupBy("conv_id").applyInArrow(_cuts, "part int, chunk int, pos long, before int, after int, opens boolean, ends boolean")
    return turns.groupBy("part", "chunk").cogroup(cuts.groupBy("part", "chunk")).applyInArrow(_render, OUT)


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, cost, text: whole conversations in one row each, for tables whose conversations fit in one."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "rendered")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("cost").alias("cost"), F.array_join(F.transform(ordered, lambda x: x["rendered"]), "").alias("text"))
