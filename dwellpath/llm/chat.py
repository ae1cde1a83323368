"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

States are what was written last: nothing, system, user or assistant. Legal sequences are an
optional system turn and then user and assistant in turn, ending with assistant. Each input
turn is kept, relabelled or merged into what was written last, and empty turns may be put in
before it or at the end; a conversation takes the cheapest way; of ways that cost the same the one whose states come first, compared turn by turn in
the order nothing, system, user, assistant, and for one pair of states the one with fewer empty turns.

A turn's choices form a matrix over states in the (min, +) algebra; beside each cost it has the
rank of the way among those from the same state, so that ties fall the same however turns are dealt out. Turns are dealt out by
ranges of (conversation, turn), so a conversation of any length lies on one or more tasks.
Conversations within one task are repaired there. A task's first and last conversations may go
on elsewhere: each such stretch gives one 4 x 4 matrix of costs and ranks, the matrices (two a task) are multiplied
along the conversation for the states at the borders, and the stretch is then repaired between
fixed states.

The result has a row a turn; ``pos`` is its place in its conversation, from 0, and the pieces of a
conversation in that order are its rendering.

Defined results: roles are matched without case and with common synonyms, other or null roles
fit any role at a small cost; null texts are empty; turns of one number, and null turns, which
come first, are ordered by a hash of role and text, then by these; an empty table gives no rows; markers inside texts are broken up; conversations with a
null id are one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.llm.spark import shuffle_width, stored

ROLES = ("system", "user", "assistant")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Other names of the roles.
SYNONYMS = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Legal next turns of each state.
NEXT = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (ASSISTANT,)
MERGE, INSERT, RELABEL, GUESS = 1, 2, 3, 1
_NEVER = 1 << 40


def role_of(role: str | None) -> int:
    """1 to 3 for a known role, 0 for any other."""
    r = (role or "").strip().lower()
    r = SYNONYMS.get(r, r)
    return ROLES.index(r) + 1 if r in ROLES else 0


def _paths() -> dict[int, dict[int, list[int]]]:
    """The empty turns to put in to come from one state to another (shortest, then by number)."""
    out: dict[int, dict[int, list[int]]] = {}
    for s in range(4):
        seen = {s: []}
        queue = [s]
        for x in queue:
            for y in NEXT[x]:
                if y not in seen:
                    seen[y] = [*seen[x], y]
                    queue.append(y)
        out[s] = seen
    return out


_INSERTS = _paths()


def choices(role: int) -> list[list[tuple[int, str, list[int]]]]:
    """[from][to] -> (cost, action, inserted turns) of the cheapest way to take in a turn."""
    table = []
    for s in range(4):
        row = []
        for t in range(4):
            ways = [(_NEVER, "", [])]
            if t != NOTHING:
                label = 0 if role == t else GUESS if role == 0 else RELABEL
                kept = "keep" if label == 0 else "relabel"
                for mid, put in _INSERTS[s].items():
                    if t in NEXT[mid]:
                        ways.append((label + INSERT * len(put), kept if not put else f"insert+{kept}", put))
                if s == t:
                    ways.append((MERGE + label, "merge", []))
            row.append(min(ways, key=lambda w: (w[0], len(w[2]), w[1])))
        table.append(row)
    return table


_CHOICES = [choices(r) for r in range(4)]
_COSTS = np.array([[[w[0] for w in row] for row in c] for c in _CHOICES], dtype=np.int64)


def _closing() -> list[tuple[int, list[int]]]:
    """Cost and inserted turns to end from each state; a conversation without turns is legal."""
    out = []
    for s in range(4):
        put = min((_INSERTS[s][f] for f in FINAL if f in _INSERTS[s]), key=len)
        out.append((0, []) if s == NOTHING else (INSERT * len(put), put))
    return out


_CLOSE = _closing()


Matrix = tuple[np.ndarray, np.ndarray]
_NO_TURN: Matrix = (np.where(np.eye(4, dtype=bool), 0, _NEVER).astype(np.int64), np.zeros((4, 4), dtype=np.int64))
_ONE_TURN: list[Matrix] = [(c, np.tile(np.arange(4), (4, 1))) for c in _COSTS]


def joined(a: Matrix, b: Matrix) -> Matrix:
    """Costs and ranks of the best ways through two stretches.

    Of midway states with one cost the one whose way there ranks first is taken; the ways from a
    state are then ranked by their first parts, and by their second where they share the first.
    """
    cost = np.minimum(a[0][:, :, None] + b[0][None, :, :], _NEVER)
    mid = (cost * 4 + a[1][:, :, None]).argmin(axis=1)
    rows = np.arange(4)[:, None]
    order = a[1][rows, mid] * 4 + b[1][mid, np.arange(4)[None, :]]
    return cost.min(axis=1), order.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")


def product(roles: list[int]) -> Matrix:
    """The joined matrices of turns."""
    m = _NO_TURN
    for r in roles:
        m = joined(m, _ONE_TURN[r])
    return m


def repair(roles: list[int], start: int, end: int | None) -> list[tuple[int, tuple[int, str, list[int]]]]:
    """(state, choice) of each turn on the cheapest way from ``start`` to ``end`` (None: to a legal end)."""
    n = len(roles)
    best = np.full((n + 1, 4), _NEVER, dtype=np.int64)
    best[n] = [_CLOSE[s][0] for s in range(4)] if end is None else [0 if s == end else _NEVER for s in range(4)]
    for i in range(n - 1, -1, -1):
        best[i] = np.minimum((_COSTS[roles[i]] + best[i + 1][None, :]).min(axis=1), _NEVER)
    out, s = [], start
    for i in range(n):
        t = int(np.argmin(_COSTS[roles[i]][s] + best[i + 1]))
        out.append((t, _CHOICES[roles[i]][s][t]))
        s = t
    return out


def _open_turn(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


_SHUT = "<|im_end|>\n"


def pieces(texts: list[str], way: list, start: int, last: bool) -> list[str]:
    """What each turn adds to the rendering; ``last`` closes the conversation."""
    out, s = [], start
    for text, (t, (_, action, put)) in zip(texts, way, strict=True):
        text = text.replace("<|im_", "<| im_")
        if action == "merge":
            out.append("\n" + text)
        else:
            shut = _SHUT if s != NOTHING else ""
            out.append(shut + "".join(_open_turn(p) + _SHUT for p in put) + _open_turn(t) + text)
        s = t
    if last and out:
        out[-1] += _SHUT + "".join(_open_turn(p) + _SHUT for p in _CLOSE[s][1])
    return out


_OUT = [("conv_id", pa.int64()), ("turn", pa.int64()), ("pos", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("piece", pa.string()), ("place", pa.int32()), ("whole", pa.bool_()), ("edge", pa.int32()), ("matrix", pa.list_(pa.int64()))]
_SCHEMA = pa.schema(_OUT)
_DDL = "conv_id long, turn long, pos long, action string, role string, piece string, place int, whole boolean, edge int, matrix array<long>"


def _finished(conv, turns, roles, texts, first, start, end, last) -> pa.RecordBatch:
    way = repair(roles, start, end)
    n = len(turns)
    cols = [[conv] * n, turns, range(first, first + n), [w[1] for _, w in way], [ROLES[t - 1] for t, _ in way], pieces(texts, way, start, last), [0] * n, [True] * n, [0] * n, [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations that lie inside this range; passes the first and last on.

    Passed turns keep their text as ``piece`` and their role as ``role``; ``edge`` is 1 for the
    range's first conversation and 2 for its last. A passed stretch ends with a row without a
    turn that has its matrix and, as ``pos``, its number of turns. A conversation is held only while it is read, but the first, which
    may be long, is passed on batch by batch.
    """
    place = TaskContext.get().partitionId()
    conv, turns, roles, texts = None, [], [], []
    edge, running, begun, sent = 1, product([]), False, 0

    def passed(edge: int) -> pa.RecordBatch:
        nonlocal sent
        n = len(turns)
        sent += n
        cols = [[conv] * n, turns, range(sent - n, sent), [None] * n, [str(r) for r in roles], texts, [place] * n, [False] * n, [edge] * n, [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    def total(edge: int, m: Matrix) -> pa.RecordBatch:
        row = [conv, None, sent, None, None, None, place, False, edge, np.concatenate(m, axis=None).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    for batch in batches:
        for c, t, r, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if begun and c != conv:
                if edge == 1:
                    running = joined(running, product(roles))
                    yield passed(1)
                    yield total(1, running)
                    edge, sent = 2, 0
                else:
                    yield _finished(conv, turns, roles, texts, 0, NOTHING, None, True)
                turns, roles, texts = [], [], []
            conv, begun = c, True
            turns.append(t), roles.append(role_of(r)), texts.append(x or "")
        if edge == 1 and turns:
            running = joined(running, product(roles))
            yield passed(1)
            turns, roles, texts = [], [], []
    if begun:
        yield passed(edge)
        yield total(edge, joined(running, product(roles)) if edge == 1 else product(roles))


def border_states(stretches: list[tuple]) -> dict[tuple[int, int], tuple[int, int, int | None, bool]]:
    """(place, edge) -> (turns before, state before, state after, last) from (conv, place, edge, matrix, turns) in order."""
    out: dict[tuple[int, int], tuple[int, int, int | None, bool]] = {}
    at = 0
    while at < len(stretches):
        to = at
        while to < len(stretches) and stretches[to][0] == stretches[at][0]:
            to += 1
        run = stretches[at:to]
        best = [np.array([_CLOSE[s][0] for s in range(4)], dtype=np.int64)]
        for x in reversed(run):
            best.append(np.minimum((x[3][0] + best[-1][None, :]).min(axis=1), _NEVER))
        best.reverse()
        s, first = NOTHING, 0
        for k, x in enumerate(run):
            cost, rank = x[3]
            t = int(np.argmin((cost[s] + best[k + 1]) * 4 + rank[s]))
            final = k == len(run) - 1
            out[x[1], x[2]] = (first, s, None if final else t, final)
            s, first = t, first + x[4]
        at = to
    return out


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, pos, action, role, piece of every turn; pieces by pos make the rendering."""
    spark = conversations.sparkSession
    # the ranges are found from samples of the order, so no text is in it
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text")]
    rows = conversations.select("conv_id", "turn", "role", "text").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order, "role", "text")
    walked = stored(rows.mapInArrow(_walk, _DDL), "whole")
    passed = walked.filter("not whole")
    # two small matrices a task, whatever the number of turns
    ends = passed.filter("matrix is not null").select("conv_id", "place", "edge", "matrix", "pos").collect()
    ends = sorted(((r["conv_id"], r["place"], r["edge"], tuple(np.array(r["matrix"], dtype=np.int64).reshape(2, 4, 4)), r["pos"]) for r in ends), key=lambda r: (r[1], r[2]))
    states = spark.sparkContext.broadcast(border_states(ends))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = states.value
        key, turns, roles, texts = None, [], [], []

        def done() -> pa.RecordBatch:
            return _finished(key[0], turns, roles, texts, *known[key[1], key[2]])

        for batch in batches:
            cols = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("conv_id", "turn", "role", "piece", "place", "edge")}
            for c, t, r, x, p, e in zip(*cols.values(), strict=True):
                if key is not None and key != (c, p, e):
                    yield done()
                    turns, roles, texts = [], [], []
                key = (c, p, e)
                turns.append(t), roles.append(int(r)), texts.append(x)
        if turns:
            yield done()

    # a stretch was one task's work, so it is no larger than a task's share of the turns
    names = ["conv_id", "turn", "role", "piece", "place", "edge", "pos"]
    ordered = passed.filter("matrix is null").select(*names).repartition(shuffle_width(spark), "place", "edge").sortWithinPartitions("place", "edge", "pos")
    late = ordered.mapInArrow(finish, _DDL)
    out = ["conv_id", "turn", "pos", "action", "role", "piece"]
    return walked.filter("whole").select(*out).unionByName(late.select(*out))
