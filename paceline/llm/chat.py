"""Chat formatting: minimum-cost role repair by dynamic programming.

Legal conversations are what this automaton accepts: system (at most once, first),
then user and assistant in turn, assistant last.  A repair may merge a turn into the
one before it, give a turn another role, or insert an empty turn; each has its cost,
and the cheapest sequence of them is found by dynamic programming over the automaton's
states (start, system, user, assistant).

The step of a turn is a 4 x 4 matrix of costs, and steps compose by (min, +)
products.  So a conversation is cut into blocks of at most ``block`` turns: blocks
give their products, the products of a conversation fix the states at its block
borders, and blocks then decode by themselves.  No conversation is one task.

Defined results: rows with a null conv_id are one conversation (null); turns are in
the order of turn (null last), role and text; null texts are empty; a null or unknown
role has to be relabelled; roles are compared in lower case without white space
around; repeated rows are turns of their own; of ties the first of: keep, user,
assistant, system, and merging last; merged texts are joined without the empty ones; a
text that holds the beginning of a control token is rendered with that broken up, so no
text can open or end a turn, and ``text`` has it unchanged; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, stash

ROLES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


@dataclass(frozen=True)
class Repair:
    merge: float = 1.0
    relabel: float = 3.0
    insert: float = 2.0
    block: int = 2048
    template: str = "<|im_start|>%s\n%s<|im_end|>\n"  # role, text
    control: str = "<|"  # what begins a control token of the template; broken up in rendered texts
    broken: str = "< |"
    joint: str = "\n\n"  # between merged texts


def _paths(p: Repair) -> dict[tuple[int, int], tuple[int, ...]]:
    """The roles to insert, fewest first, so that one state may follow another."""
    found = {x: () for x in LEGAL}
    for _ in range(3):
        for (a, b), via in list(found.items()):
            for c in (USER, ASSISTANT, SYSTEM):
                if (b, c) in LEGAL and (a, c) not in found:
                    found[a, c] = (*via, b)
    return found


def _steps(p: Repair):
    """For each role of a turn: [(cost, from, to, merged, inserted)] by state pair, the cheapest only."""
    via = _paths(p)
    out = {}
    for role in (SYSTEM, USER, ASSISTANT, None):
        best: dict[tuple[int, int], tuple] = {}
        for to in sorted((SYSTEM, USER, ASSISTANT), key=lambda x: (x != role, x != USER, x != ASSISTANT)):
            cost = 0.0 if to == role else p.relabel
            for at in range(4):
                options = []
                if (at, to) in via:
                    options.append((cost + p.insert * len(via[at, to]), False, via[at, to]))
                if at == to:
                    options.append((cost + p.merge, True, ()))
                if options:
                    best[at, to] = min(options, key=lambda x: (x[0], x[1]))
        out[role] = best
    return out


def _role(x: str | None) -> int | None:
    x = (x or "").strip().lower()
    return ROLES.index(x) if x in ROLES[1:] else None


def _end_cost(p: Repair) -> np.ndarray:
    via = _paths(p)
    return np.array([0.0, *(p.insert * (len(via[s, ASSISTANT]) + 1) if s != ASSISTANT else 0.0 for s in (SYSTEM, USER, ASSISTANT))])


def product(roles: list[str | None], p: Repair) -> np.ndarray:
    """Costs from each state before these turns to each state after them."""
    steps = {r: _matrix(x) for r, x in _steps(p).items()}
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        total = (total[:, :, None] + steps[_role(r)][None]).min(1)
    return total


def _matrix(best) -> np.ndarray:
    m = np.full((4, 4), np.inf)
    for (a, b), x in best.items():
        m[a, b] = x[0]
    return m


def decode(roles: list[str | None], first: int, last: int, p: Repair) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(label, merged into the turn before, roles inserted before it) of each turn, at least cost."""
    steps = _steps(p)
    mats = {r: _matrix(x) for r, x in steps.items()}
    cost = np.full((len(roles) + 1, 4), np.inf)
    cost[0, first] = 0
    for i, r in enumerate(roles):
        cost[i + 1] = (cost[i][:, None] + mats[_role(r)]).min(0)
    out, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        r = _role(roles[i])
        options = cost[i] + mats[r][:, state]
        before = min(range(4), key=lambda s: (options[s], s == state, (USER, ASSISTANT, SYSTEM, START).index(s)))
        _, merged, inserted = steps[r][before, state]
        out.append((state, merged, inserted))
        state = before
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches; a run is a block, so it is small."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = column(batch, k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            if held and column(held[-1], k)[-1].as_py() != x[0]:
                new[0] = True
        at = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _products(p: Repair):
    def run(batches):
        rows = []
        for t in _groups(batches, ("c", "block")):
            rows.append((t["c"][0].as_py(), t["block"][0].as_py(), product(t["role"].to_pylist(), p).ravel().tolist()))
            if len(rows) == 4096:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows):
        c, b, m = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.list_(pa.float64()))], names=["c", "block", "m"])

    return run


def _borders(p: Repair):
    """(c, block, first, last, cost): the states around each block of a conversation."""
    end = _end_cost(p)

    def run(batches):
        rows = []
        for t in _groups(batches, ("c",)):
            mats = [np.array(m).reshape(4, 4) for m in t["m"].to_pylist()]
            cost = [np.array([0, np.inf, np.inf, np.inf])]
            for m in mats:
                cost.append((cost[-1][:, None] + m).min(0))
            order = (ASSISTANT, USER, SYSTEM, START)
            total = cost[-1] + end
            state = min(range(4), key=lambda s: (total[s], order.index(s)))
            least, marks = float(total[state]), []
            for i in range(len(mats) - 1, -1, -1):
                options = cost[i] + mats[i][:, state]
                before = min(range(4), key=lambda s: (options[s], order.index(s)))
                marks.append((before, state))
                state = before
            for block, (a, b) in zip(t["block"].to_pylist(), marks[::-1], strict=True):
                rows.append((t["c"][0].as_py(), block, a, b, least, block == len(mats) - 1))
            if len(rows) >= 4096:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["c", "block", "first", "last", "cost", "final"])

    return run


PART = "c long, block long, n long, part long, role string, text string, merged int, relabelled int, inserted int"


def _decode(p: Repair):
    via = _paths(p)
    names = [x.split()[0] for x in PART.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int32()] * 3

    def run(batches):
        rows, room = [], 4_000_000  # characters
        for t in _groups(batches, ("c", "block")):
            c, block = t["c"][0].as_py(), t["block"][0].as_py()
            roles, texts = t["role"].to_pylist(), t["text"].to_pylist()
            part = 0  # turns opened in this block so far; 0 goes on with the turn of the block before
            for n, (label, merged, inserted) in enumerate(decode(roles, t["first"][0].as_py(), t["last"][0].as_py(), p)):
                for x in inserted:
                    part += 1
                    rows.append((c, block, n, part, ROLES[x], "", 0, 0, 1))
                part += not merged
                rows.append((c, block, n, part, ROLES[label], texts[n] or "", int(merged), int(_role(roles[n]) != label), 0))
            if t["final"][0].as_py() and (last := t["last"][0].as_py()) != ASSISTANT:
                for x in (*via[last, ASSISTANT], ASSISTANT):
                    part += 1
                    rows.append((c, block, len(roles), part, ROLES[x], "", 0, 0, 1))
            room -= sum(len(x or "") for x in texts)
            if len(rows) > 5000 or room < 0:
                room = 4_000_000
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


_NULL_ID = -(2**63)


def repair(turns: DataFrame, params: Repair = Repair()) -> DataFrame:
    """One row per turn of the repaired conversations.

    conv_id, turn_no (from 0), role, text, rendered, merged (turns merged into this
    one), relabelled (of its turns), inserted (1 for an empty turn that was put in),
    cost (of the whole conversation's repair).
    """
    p = params
    t = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NULL_ID)).alias("c"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Positions in two steps: inside bins of turn numbers, then over the bins.
    t = t.withColumn("bin", F.coalesce(F.floor(F.col("turn") / 512), F.lit(2**62)))
    inside = Window.partitionBy("c", "bin").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    bins = t.groupBy("c", "bin").agg(F.count("*").alias("k"))
    ahead = Window.partitionBy("c").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("c", "bin", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"))
    t = t.withColumn("n", F.row_number().over(inside) - 1).join(bins, ["c", "bin"]).withColumn("n", F.col("n") + F.col("before"))
    t = stash(t.select("c", (F.col("n") / p.block).cast("long").alias("block"), "n", "role", "text"), "turns")

    by_block = t.select("c", "block", "n", "role").repartition("c", "block").sortWithinPartitions("c", "block", "n")
    products = by_block.select("c", "block", "role").mapInArrow(_products(p), "c long, block long, m array<double>")
    borders = products.repartition("c").sortWithinPartitions("c", "block").mapInArrow(_borders(p), "c long, block long, first int, last int, cost double, final boolean")
    borders = stash(borders, "borders")

    placed = t.join(borders, ["c", "block"]).repartition("c", "block").sortWithinPartitions("c", "block", "n")
    parts = stash(placed.select("c", "block", "role", "text", "first", "last", "final").mapInArrow(_decode(p), PART), "parts")
    opened = parts.groupBy("c", "block").agg(F.max("part").alias("k"))
    over = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select("c", "block", F.coalesce(F.sum("k").over(over), F.lit(0)).alias("before"))
    whole = parts.join(opened, ["c", "block"]).withColumn("turn_no", F.col("before") + F.col("part") - 1)
    whole = whole.groupBy("c", "turn_no").agg(
        F.first("role").alias("role"),
        F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "text"))), lambda x: x["text"]).alias("texts"),
        F.sum("merged").alias("merged"),
        F.sum("relabelled").alias("relabelled"),
        F.max("inserted").alias("inserted"),
    )
    text = F.array_join(F.filter("texts", lambda x: x != ""), p.joint)
    safe = F.replace(text, F.lit(p.control), F.lit(p.broken)) if p.control else text
    costs = borders.where("final").select("c", "cost")
    head, middle, tail = p.template.split("%s")
    return whole.join(costs, "c").select(
        F.when(F.col("c") != _NULL_ID, F.col("c")).alias("conv_id"),
        "turn_no",
        "role",
        text.alias("text"),
        F.concat(F.lit(head), "role", F.lit(middle), safe, F.lit(tail)).alias("rendered"),
        "merged",
        "relabelled",
        "inserted",
        "cost",
    )
