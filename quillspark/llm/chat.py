"""Chat formatting with minimum-cost role repair.

The legal order of turns is an automaton: a conversation opens with system or user, after system comes user, and then
assistant and user alternate; it ends after user or assistant. Dynamic programming chooses, for all turns together, the
cheapest of: keep a turn; merge it into the turn before (of its role); give it another role; insert an empty turn before it.

One step of the program is a table of costs from state to state, and tables of neighbouring turns combine by minimum and
sum. Turns are dealt out in ranges of (conv_id, turn, role, text), so a conversation of any length is spread over many tasks, and cut
into blocks of at most ``BLOCK`` rows. A conversation that is one block inside its range is decoded at once. Of all others, each block is
summed up in one table of costs; these are summed up once more for each range, the ranges are chained for each conversation, then the
blocks in each range, and blocks are decoded independently between the states that the chain has fixed.
A task holds one Arrow batch and one block.

Defined cases: turns order by (turn, role, text), nulls first, so repeated turns stay, in a fixed order; roles are trimmed of ASCII white space and
lower-cased; a null or unknown role always gets another, at a lower cost; a null text is empty; a very long text is passed on as it is; rows of a null conv_id are
one conversation; an empty table gives an empty result; other columns are ignored, whatever their names. Ties: the action that comes first in
keep, merge, relabel, merge after relabel, insert; and the state that comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete, joined, table

BLOCK = 512
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = {USER, ASSISTANT}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
NEVER = 1 << 40


def moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state before, state after) -> cheapest (cost, action, roles of empty turns inserted before) for a turn of ``role`` (0: unknown)."""
    best: dict[tuple[int, int], tuple[int, str, tuple[int, ...]]] = {}

    def offer(a, b, cost, action, inserted):
        if (a, b) not in best or cost < best[a, b][0]:
            best[a, b] = (cost, action, inserted)

    change = {r: 0 if r == role else RELABEL if role else UNKNOWN for r in (SYSTEM, USER, ASSISTANT)}
    for a in range(4):
        for b in NEXT[a]:
            offer(a, b, change[b], "relabel" if change[b] else "keep", ())
        if a:
            offer(a, a, MERGE + change[a], "relabel_merge" if change[a] else "merge", ())
        for m in NEXT[a]:
            for b in NEXT[m]:
                offer(a, b, INSERT + change[b], "insert_relabel" if change[b] else "insert", (m,))
    return best


MOVES = [moves(r) for r in range(4)]
COST = np.full((4, 4, 4), NEVER, np.int64)
for _r, _m in enumerate(MOVES):
    for (_a, _b), _x in _m.items():
        COST[_r, _a, _b] = _x[0]
#: From the state after the last turn to a legal end: an empty user turn if need be.
END = np.array([INSERT if s not in FINAL else 0 for s in range(4)], np.int64)


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum((x[:, :, None] + y[None, :, :]).min(1), NEVER)


def render(role: int, text: str | None) -> str:
    return f"<|{ROLES[role]}|>\n" + ("" if text is None else text)


#: By role, state before and state after: action, inserted roles, cost; and what goes before the text, in a conversation's first turn and in others.
_WAYS = [(r, a, b, *MOVES[r].get((a, b), (0, "", ()))) for r in range(4) for a in range(4) for b in range(4)]
_ACTION = pa.array([w[4] for w in _WAYS])
_INSERTED = pa.array([",".join(ROLES[m] for m in w[5]) for w in _WAYS])
_STEP = np.array([w[3] for w in _WAYS], np.int64)
_BEFORE = pa.array(["\n" if "merge" in w[4] else end + "".join(render(m, "") + "<|end|>\n" for m in w[5]) + render(w[2], "") for end in ("<|end|>\n", "") for w in _WAYS])
_BEHIND = pa.array(["", "<|end|>\n", "<|end|>\n" + render(USER, "") + "<|end|>\n"])
_ROLE = pa.array(ROLES)


def _steps(size: np.ndarray):
    """For each place in a block, from 0 on, the blocks that have it."""
    order = np.argsort(-size, kind="stable")
    long = size[order]
    for j in range(int(size.max(initial=0))):
        yield j, order[: int(np.searchsorted(-long, -j, side="left"))]


def sums(roles: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The table of costs of each block."""
    out = np.zeros((len(size), 4, 4), np.int64)
    for j, some in _steps(size):
        step = COST[roles[start[some] + j]]
        out[some] = step if j == 0 else np.minimum((out[some][:, :, :, None] + step[:, None, :, :]).min(2), NEVER)
    return out


def decode(roles: np.ndarray, start: np.ndarray, size: np.ndarray, state_in: np.ndarray, state_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each turn on a cheapest way through each block."""
    n = len(roles)
    to_go = np.zeros((n, 4), np.int64)
    now = np.where(np.arange(4) == state_out[:, None], 0, NEVER)
    for j, some in _steps(size):
        at = start[some] + size[some] - 1 - j
        to_go[at] = now[some]
        now[some] = np.minimum((COST[roles[at]] + now[some][:, None, :]).min(2), NEVER)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    state = state_in.astype(np.int64).copy()
    for j, some in _steps(size):
        at = start[some] + j
        before[at] = state[some]
        state[some] = after[at] = (COST[roles[at], state[some]] + to_go[at]).argmin(1)
    return before, after


def chain(tables: np.ndarray, state: int, to_go: np.ndarray) -> tuple[list[int], int]:
    """The states between neighbouring blocks on a cheapest way from ``state``, and its cost with ``to_go`` at the end."""
    left = [to_go]
    for m in tables[::-1]:
        left.append(np.minimum((m + left[-1][None, :]).min(1), NEVER))
    left.reverse()
    cost, states = int(left[0][state]), [state]
    for m, rest in zip(tables, left[1:]):
        states.append(int((m[states[-1]] + rest).argmin()))
    return states, cost


_TURN = ["conv_id", "turn", "role", "text", "r"]
_DONE = "action string, new_role string, inserted string, cost long, conv_cost long, rendered string"
_DEALT = "conv_id long, turn long, role string, text string, r int, " + _DONE + ", part int, block long, place int, sums array<long>"


def _rendered(b: pa.RecordBatch, before, after, opens, closes, conv_cost) -> list[pa.Array]:
    """The columns of ``_DONE``; ``opens`` and ``closes`` mark the first and the last turns of conversations."""
    way = np.asarray(b.column("r")) * 16 + before * 4 + after
    take = pa.array(way)
    behind = np.where(closes, np.where(END[after] > 0, 2, 1), 0)
    text = pc.binary_join_element_wise(_BEFORE.take(pa.array(way + 64 * opens)), pc.fill_null(b.column("text"), ""), _BEHIND.take(pa.array(behind)), "")
    return [_ACTION.take(take), _ROLE.take(pa.array(after)), _INSERTED.take(take), pa.array(_STEP[way] + np.where(closes, END[after], 0)), pa.array(conv_cost), text]


def _deal(batches):
    """Cuts sorted turns into blocks. Conversations of one block inside the partition come out decoded; the turns of others with their block's number, and
    its first turn with its table of costs."""
    part, block, held, done = TaskContext.get().partitionId(), 0, None, 0

    def out(b: pa.RecordBatch, start, size, whole):
        nonlocal block
        roles = np.asarray(b.column("r"))
        costs = sums(roles, start, size)
        at = np.zeros(b.num_rows, bool)
        for k in np.flatnonzero(whole):
            at[start[k] : start[k] + size[k]] = True
        none = lambda kind, n: pa.nulls(n, kind)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        if at.any():
            w = b.filter(pa.array(at))
            n, s, m = w.num_rows, size[whole], costs[whole][:, START, :] + END
            begin = np.cumsum(s) - s
            before, after = decode(np.asarray(w.column("r")), begin, s, np.full(len(s), START), m.argmin(1))
            opens, closes = np.zeros(n, bool), np.zeros(n, bool)
            opens[begin], closes[begin + s - 1] = True, True
            cols = [*(w.column(c) for c in _TURN[:3]), none(pa.string(), n), w.column("r"), *_rendered(w, before, after, opens, closes, np.repeat(m.min(1), s))]
            yield pa.RecordBatch.from_arrays([*cols, none(pa.int32(), n), none(pa.int64(), n), none(pa.int32(), n), none(pa.list_(pa.int64()), n)], names=[x.split()[0] for x in _DEALT.split(", ")])
        if not at.all():
            w, s = b.filter(pa.array(~at)), size[~whole]
            n, first = w.num_rows, np.cumsum(s) - s
            place = np.arange(n) - np.repeat(first, s)
            ends = np.zeros(n + 1, np.int32)
            ends[first + 1] = 16
            costs_ = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(costs[~whole].reshape(-1)), mask=pa.array(place > 0))
            cols = [*(w.column(c) for c in _TURN), *(none(k, n) for k in kinds), pa.array(np.full(n, part, np.int32)), pa.array(block + np.repeat(np.arange(len(s)), s)), pa.array(place.astype(np.int32)), costs_]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _DEALT.split(", ")])
            block += len(s)

    begun = 0  # rows of the held conversation that have come out, and whether any has
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else joined([held, b])
        conv = b.column("conv_id")
        key, null = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, bool)
        new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, b.num_rows))
        many = -(-size // BLOCK)
        of = np.repeat(np.arange(len(first)), many)
        start = first[of] + BLOCK * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
        length = np.diff(np.append(start, b.num_rows))
        # The last block waits, as its conversation may go on. The partition's first conversation may have begun before.
        whole = (many[of] == 1) & (np.arange(len(of)) > 0) if not done else (many[of] == 1) & ((of > 0) | (begun == 0))
        if len(start) > 1:
            yield from out(b.slice(0, int(start[-1])), start[:-1], length[:-1], whole[:-1])
            begun = (begun if of[-1] == 0 else 0) + int(many[-1] - 1)
            done = 1
        held = b.slice(int(start[-1]))
    if held is not None:
        yield from out(held, np.zeros(1, np.int64), np.array([held.num_rows]), np.zeros(1, bool))


def _tables(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("sums")
    return np.asarray(x.flatten()).reshape(-1, 4, 4)


def _groups(b: pa.RecordBatch, key: str):
    """(first, end) of the runs of equal values."""
    col = b.column(key).dictionary_encode().indices.to_numpy()
    at = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
    return zip(at.tolist(), [*at[1:].tolist(), len(col)])


def _sum_up(batches):
    """One table of costs for the blocks of a conversation in one range."""
    for b in complete(batches, ["part", "conv"]):
        tables, rows = _tables(b), []
        pair = b.append_column("pair", pc.binary_join_element_wise(b.column("part").cast(pa.string()), b.column("conv"), " "))
        for x, y in _groups(pair, "pair"):
            total = tables[x]
            for m in tables[x + 1 : y]:
                total = combine(total, m)
            rows.append((x, total.reshape(-1).tolist()))
        take = pa.array([x for x, _ in rows])
        yield pa.RecordBatch.from_arrays([b.column("conv").take(take), b.column("part").take(take), pa.array([m for _, m in rows], pa.list_(pa.int64()))], names=["conv", "part", "sums"])


_BORDERS = "state_in int, state_out int, opens boolean, closes boolean, conv_cost long"


def _chain_ranges(batches):
    for b in complete(batches, ["conv"]):
        tables, out = _tables(b), []
        for x, y in _groups(b, "conv"):
            states, cost = chain(tables[x:y], START, END)
            out += [(s, t, i == 0, i == y - x - 1, cost) for i, (s, t) in enumerate(zip(states, states[1:]))]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())))], names=["conv", "part", *(x.split()[0] for x in _BORDERS.split(", "))])


def _chain_blocks(batches):
    for b in complete(batches, ["part", "conv"]):
        tables, out = _tables(b), []
        pair = b.append_column("pair", pc.binary_join_element_wise(b.column("part").cast(pa.string()), b.column("conv"), " "))
        for x, y in _groups(pair, "pair"):
            row = {c: b.column(c)[x].as_py() for c in ("state_in", "state_out", "opens", "closes", "conv_cost")}
            states, _ = chain(tables[x:y], row["state_in"], np.where(np.arange(4) == row["state_out"], 0, NEVER))
            out += [(s, t, row["opens"] and i == 0, row["closes"] and i == y - x - 1, row["conv_cost"]) for i, (s, t) in enumerate(zip(states, states[1:]))]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("block"), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())))], names=["part", "block", *(x.split()[0] for x in _BORDERS.split(", "))])


def _decode_blocks(batches):
    for b in complete(batches, ["part", "block"]):
        place = np.asarray(b.column("place"))
        start = np.flatnonzero(place == 0)
        size = np.diff(np.append(start, len(place)))
        col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        before, after = decode(col("r"), start, size, col("state_in")[start], col("state_out")[start])
        opens = col("opens") & (place == 0)
        closes = col("closes") & (np.append(place[1:], 0) == 0)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _TURN[:3]), *_rendered(b, before, after, opens, closes, col("conv_cost"))], names=[*_TURN[:3], *(x.split()[0] for x in _DONE.split(", "))])


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, role, action, new_role, inserted (roles of empty turns before it), cost, conv_cost (least cost
    of the conversation) and rendered. The rendered pieces of a conversation, joined in order of turns, are its text; a last
    system turn gets an empty user turn after it."""
    name = F.lower(F.btrim(F.col("role"), F.lit(" \t\n\r\x0b\x0c")))
    code = F.coalesce(F.expr("array_position(array('system', 'user', 'assistant'), name)"), F.lit(0)).cast("int")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", name.alias("name")).select("conv_id", "turn", "role", "text", code.alias("r"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = table(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_deal, _DEALT), "dealt")
    keys = ["conv_id", "turn", "role"]
    done = ["action", "new_role", "inserted", "cost", "conv_cost", "rendered"]
    open_ = dealt.where("part is not null")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    blocks = open_.where("place = 0").select(conv, "part", "block", "sums")
    ranges = blocks.repartition("part", "conv").sortWithinPartitions("part", "conv", "block").mapInArrow(_sum_up, "conv string, part int, sums array<long>")
    borders = ranges.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_chain_ranges, f"conv string, part int, {_BORDERS}")
    inner = blocks.join(borders, ["part", "conv"]).repartition("part", "conv").sortWithinPartitions("part", "conv", "block").mapInArrow(_chain_blocks, f"part int, block long, {_BORDERS}")
    rest = open_.select("part", "block", "place", "conv_id", "turn", "role", "text", "r").join(inner, ["part", "block"]).repartition("part", "block").sortWithinPartitions("part", "block", "place")
    return dealt.where("part is null").select(*keys, *done).union(rest.mapInArrow(_decode_blocks, f"conv_id long, turn long, role string, {_DONE}").select(*keys, *done))
