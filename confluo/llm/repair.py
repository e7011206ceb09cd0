"""Cheapest repair of conversations by a time-major dynamic program in numpy.

A conversation's turns are kept, given another role, deleted, or preceded by an inserted empty turn, so that the
roles' initials read ``(s?(ua)+)?``. Four states stand for what has been written so far: nothing, only ``s``, ``..u``
and ``..ua``. Conversations are put in buckets by length; going backwards, one numpy step per turn updates the costs to
go of all states of all conversations of a bucket. The costs are stored, and the edits are then traced forward, again
one step for all: of the edits that stay cheapest the one with the least letter (D, I, K, R) is taken, which gives the
least string of edits among the cheapest.

At scale: equal rows of a conversation are counted, not kept, and turns are range partitioned in order, so a long
conversation lies in several partitions. All within a partition are repaired there. For the first and last conversation
of each partition, which may go on elsewhere, a partition gives its 4 x 4 matrix of costs; matrices of a conversation's
parts are combined backwards, then the states in which the parts are entered forwards, at most two small rows per
partition each; then every part is traced on its own. Only the digest of a repaired conversation is made in order.

Defined results: nulls of role and text are one space. Turns are in order of turn (nulls first), then role, then text
by code point; a null conversation id is a conversation. Equal rows count as often as they occur. A conversation
without rows, or only with rows that aren't there (``copies`` 0), has an empty repair. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.jobs import saved

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 2, 3, 2, 1
#: States: nothing yet, only a system turn, user turn last, assistant turn last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after keeping a turn of role s, u, a or another (rows) in each state (columns); -1: not possible.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: State after inserting a turn or giving one another role, in each state.
GIVEN = np.array([USER, USER, ASSISTANT, USER])
NEVER = 1 << 40
#: Cells (turns times conversations) of a bucket, turns that are repaired at once, and characters of a piece of text.
CELLS, TURNS, PIECE = 1 << 19, 1 << 15, 1 << 20
ROLES = {USER: "user", ASSISTANT: "assistant"}


def settled(costs: np.ndarray) -> np.ndarray:
    """Costs to go (..., 4) when turns may be inserted first."""
    out = costs.copy()
    out[..., USER] = np.minimum(costs[..., USER], INSERT_COST + costs[..., ASSISTANT])
    out[..., ASSISTANT] = np.minimum(costs[..., ASSISTANT], INSERT_COST + costs[..., USER])
    for start in (NONE, SYSTEM):
        out[..., start] = np.minimum(costs[..., start], INSERT_COST + out[..., USER])
    return out


#: Costs to go at a conversation's end.
END = settled(np.array([0, NEVER, NEVER, 0], np.int64))


def backward(code: np.ndarray, must: np.ndarray, cut: np.ndarray, extra: np.ndarray, there: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go (turns + 1, conversations, 4) of a bucket from (turns, conversations) arrays: role code, whether the
    turn has to go, whether it is truncated, the cost of its further copies, whether it is there at all (padding
    isn't), and the costs at the end (conversations, 4)."""
    turns, size = code.shape
    costs = np.empty((turns + 1, size, 4), np.int64)
    costs[turns] = end
    for i in range(turns - 1, -1, -1):
        later = costs[i + 1]
        best = later + DELETE_COST
        kept = KEPT[code[i]]
        keep = np.where(kept >= 0, np.take_along_axis(later, np.maximum(kept, 0), 1), NEVER)
        other = np.minimum(keep, later[:, GIVEN] + REROLE_COST) + CUT_COST * cut[i][:, None]
        best = np.where(must[i][:, None], best, np.minimum(best, other)) + extra[i][:, None]
        costs[i] = np.where(there[i][:, None], settled(best), later)
    return costs


def traced(code, must, cut, extra, sizes, costs, entry, last) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of all conversations of a bucket, step by step: (conversation, letter, turn or -1, state after it)."""
    at, state, out = np.zeros(len(sizes), np.int64), entry.copy(), []
    active = np.arange(len(sizes))
    top = max(len(code) - 1, 0)
    while len(active):
        p, q = at[active], state[active]
        more = p < sizes[active]
        ends = ~more & (~last[active] | (q == NONE) | (q == ASSISTANT))
        active, p, q, more = active[~ends], p[~ends], q[~ends], more[~ends]
        if not len(active):
            break
        row = np.minimum(p, top)
        now, later = costs[p, active, q], costs[np.minimum(p + 1, len(code)), active]
        given, each = GIVEN[q], np.arange(len(active))
        if len(code):
            may, add = more & ~must[row, active], cut[row, active] * CUT_COST + extra[row, active]
            kept = KEPT[code[row, active], q]
            delete = more & (later[each, q] + DELETE_COST + extra[row, active] == now)
            keep = may & (kept >= 0) & (later[each, kept] + add == now)
        else:
            kept, delete, keep = given, more, more
        insert = costs[p, active, given] + INSERT_COST == now
        letter = np.select([delete, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8)
        after = np.select([delete, keep & ~insert], [q, kept], given)
        out.append((active, letter, np.where(letter == ord("I"), -1, p), after))
        at[active] = p + (letter != ord("I"))
        state[active] = after
    return out


def buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Conversations of similar length together, at most CELLS cells at once."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (sizes[order[to]] + 1) * (to + 1 - at) <= CELLS and sizes[order[to]] <= 2 * sizes[order[at]] + 8:
            to += 1
        yield order[at:to]
        at = to


class Turns:
    """Turns of several conversations, one after the other: conversation i has rows starts[i]:starts[i + 1]."""

    def __init__(self, batch: pa.RecordBatch, starts: np.ndarray):
        take = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        n = take("n")
        self.rows = np.flatnonzero(n > 0)
        self.starts = np.searchsorted(self.rows, starts)
        self.sizes = np.diff(self.starts)
        self.n = n[self.rows]
        self.code, self.must, self.cut = take("code")[self.rows].astype(np.int64), take("must")[self.rows].astype(bool), take("cut")[self.rows].astype(np.int64)

    def grid(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(turns, conversations) arrays of some conversations: code, must, cut, extra, there."""
        most = int(self.sizes[which].max(initial=0))
        place = np.minimum(self.starts[which] + np.arange(most)[:, None], max(len(self.rows) - 1, 0))
        there = np.arange(most)[:, None] < self.sizes[which]
        return self.code[place], self.must[place], self.cut[place], DELETE_COST * (self.n[place] - 1), there

    def illegal(self, i: int) -> int:
        """Neighbours of one conversation whose initials aren't su, ua or au."""
        a, b = self.starts[i], self.starts[i + 1]
        code, n = self.code[a:b], self.n[a:b]
        return int((n - 1).sum() + (~legal(code[:-1], code[1:])).sum())


def legal(a, b):
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def changes(column: pa.Array) -> np.ndarray:
    """Rows at which the value differs from the row before, by number; a null is a value."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    differ = pc.fill_null(pc.not_equal(a, b), pa.scalar(True))
    differ = pc.and_not(differ, pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool, bool]]:
    """(rows, starts of the conversations in them and their end, whether the first is the partition's first, whether
    the last is its last); conversations come whole, many at a time, as far as the partition has them."""
    held: list[pa.RecordBatch] = []
    first = True

    def joined() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < TURNS:
            continue
        inner = changes(batch.column("conv"))
        crosses = len(held) > 1 and not _same(held[-2].column("conv")[-1], batch.column("conv")[0])
        if not len(inner) and not crosses:
            continue  # one long conversation so far
        rows = joined()
        starts = np.concatenate([[0], changes(rows.column("conv"))]).astype(np.int64)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts, first, False
            first, held = False, [rows.slice(starts[-1])]
    if held:
        rows = joined()
        yield rows, np.concatenate([[0], changes(rows.column("conv")), [len(rows)]]).astype(np.int64), first, True


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def matrix(turns: Turns, i: int) -> np.ndarray:
    """Cost of entering a part in each state and leaving it in each, (4, 4)."""
    grid = turns.grid(np.full(4, i))
    return backward(*grid, np.where(np.eye(4, dtype=bool), 0, NEVER))[0].T


def faults(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """Different turns, how often each occurs and its first fault: conv, turn, role, text, n, blank, cut (truncated),
    code of the role, must (has to go: blank, or the same as an earlier turn)."""
    given = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("copies"))
    counted = given.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    counted = counted.withColumns({"digest": F.sha2(F.concat_ws("\0", "role", "text"), 256), "late": F.col("turn").isNotNull()})
    first = counted.filter("n > 0").groupBy("conv", "digest").agg(F.min(F.struct("late", "turn")).alias("at"))
    first = first.select(F.col("conv").alias("conv_"), F.col("digest").alias("digest_"), F.col("at.turn").alias("turn_"), F.lit(True).alias("first"))
    same = F.col("digest").eqNullSafe(F.col("digest_")) & F.col("conv").eqNullSafe(F.col("conv_")) & F.col("turn").eqNullSafe(F.col("turn_"))
    found = counted.join(first, same, "left")
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    again = F.col("first").isNull()
    cut = ~blank & ~again & ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return found.select("conv", "turn", "role", "text", "n", blank.alias("blank"), cut.alias("cut"), code.cast("byte").alias("code"), (blank | again).alias("must"))


class Repair:
    """The repair of a table of turns (from ``faults``). ``digests`` gives a row per conversation, ``turns`` the edits."""

    def __init__(self, found: DataFrame):
        kept = found.select("conv", "turn", "role", F.when(~F.col("must"), F.col("text")).alias("text"), "n", "code", "must", "cut", "blank", F.col("text").alias("whole"))
        placed = kept.repartitionByRange("conv", "turn", "role", "whole").sortWithinPartitions("conv", "turn", "role", "whole").drop("whole")
        self.rows = saved(placed.withColumn("share", F.spark_partition_id()))
        self.counts = counts(self.rows)
        self.conv = self.rows.schema["conv"].dataType.simpleString()
        self.parts = saved(self._entered(self._ended(self._matrices())))

    def _small(self, *more: str) -> DataFrame:
        return self.rows.select("conv", "share", "n", "code", "must", "cut", *more)

    def _matrices(self) -> DataFrame:
        """(conv, share, matrix) of each partition's first and last conversation."""

        def run(batches):
            for rows, starts, first, last in runs(batches):
                turns = Turns(rows, starts)
                ends = sorted(({0} if first else set()) | ({len(starts) - 2} if last else set()))
                if ends:
                    at = pa.array(starts[ends])
                    yield pa.RecordBatch.from_arrays([rows.column("conv").take(at), rows.column("share").take(at), pa.array([matrix(turns, i).ravel().tolist() for i in ends], pa.list_(pa.int64()))], ["conv", "share", "matrix"])

        return self._small().mapInArrow(run, f"conv {self.conv}, share int, matrix array<long>")

    def _chained(self, rows: DataFrame, step, schema: str) -> DataFrame:
        """``step`` over the parts of each conversation in order, a few numbers per part."""

        def run(batches):
            for rows, starts, _, _ in runs(batches):
                for a, b in zip(starts[:-1], starts[1:]):
                    yield pa.RecordBatch.from_pylist(step(rows.slice(a, b - a).to_pylist()), schema=kinds)

        kinds = pa.schema([("conv", _arrow(self.conv)), ("share", pa.int32()), ("last", pa.bool_()), *([("entry", pa.int32())] if "entry" in schema else []), ("end", pa.list_(pa.int64()))])
        return rows.repartition("conv").sortWithinPartitions("conv", "share").mapInArrow(run, schema)

    def _ended(self, matrices: DataFrame) -> DataFrame:
        """(conv, share, last, end): the costs to go where each part ends."""

        def step(parts):
            end, out = END, []
            for p in reversed(parts):
                out.append({"conv": p["conv"], "share": p["share"], "last": not out, "end": end.tolist()})
                end = (np.array(p["matrix"]).reshape(4, 4) + end).min(axis=1)
            return out

        return self._chained(matrices, step, f"conv {self.conv}, share int, last boolean, end array<long>")

    def _with_parts(self, parts: DataFrame, *columns: str) -> DataFrame:
        """Turns beside what is known of their part; the table of parts has two rows a partition at most."""
        known = parts.select(F.col("conv").alias("conv_"), F.col("share").alias("share_"), *parts.columns[2:])
        return self._small(*columns).join(F.broadcast(known), (F.col("share") == F.col("share_")) & F.col("conv").eqNullSafe(F.col("conv_")), "left").drop("conv_", "share_")

    def _entered(self, ended: DataFrame) -> DataFrame:
        """(conv, share, last, entry, end): the state in which each part is entered."""
        ended = saved(ended)

        def run(batches):
            for rows, starts, _, _ in runs(batches):
                turns = Turns(rows, starts)
                for i, a in enumerate(starts[:-1]):
                    end = rows.column("end")[a].as_py()
                    if end is not None:
                        last = rows.column("last")[a].as_py()
                        grid = turns.grid(np.full(4, i))
                        costs = backward(*grid, np.tile(np.array(end), (4, 1)))
                        left = np.arange(4)
                        for who, _, _, after in traced(*grid[:4], np.full(4, turns.sizes[i]), costs, np.arange(4), np.full(4, last)):
                            left[who] = after
                        yield pa.RecordBatch.from_arrays([rows.column(c).slice(a, 1) for c in ("conv", "share", "last", "end")] + [pa.array([left.tolist()], pa.list_(pa.int32()))], ["conv", "share", "last", "end", "left"])

        maps = self._with_parts(ended).mapInArrow(run, f"conv {self.conv}, share int, last boolean, end array<long>, left array<int>")

        def step(parts):
            state, out = NONE, []
            for p in parts:
                out.append({"conv": p["conv"], "share": p["share"], "last": p["last"], "entry": state, "end": p["end"]})
                state = p["left"][state]
            return out

        return self._chained(maps, step, f"conv {self.conv}, share int, last boolean, entry int, end array<long>")

    def turns(self) -> DataFrame:
        """conv, share, item, edit, copies, turn, role, text: the edits in order of share and item. ``copies`` is how often the
        turn occurs, all but the first of which are deleted; ``turn`` is null for inserted turns, role and text for deleted ones."""

        def run(batches):
            for rows, starts, _, _ in runs(batches):
                for i, _, _, items in repaired(rows, starts, ("turn", "role", "text")):
                    conv, share = rows.column("conv")[starts[i]].as_py(), rows.column("share")[starts[i]].as_py()
                    made = [{"conv": conv, "share": share, "item": k, "edit": e, "copies": n, "turn": t, "role": r, "text": x} for k, (e, n, t, r, x) in enumerate(items)]
                    if made:
                        yield pa.RecordBatch.from_pylist(made, schema=kinds)

        turn = self.rows.schema["turn"].dataType.simpleString()
        kinds = pa.schema([("conv", _arrow(self.conv)), ("share", pa.int32()), ("item", pa.int32()), ("edit", pa.string()), ("copies", pa.int64()), ("turn", _arrow(turn)), ("role", pa.string()), ("text", pa.string())])
        return self._with_parts(self.parts, "turn", "role", "text").mapInArrow(run, f"conv {self.conv}, share int, item int, edit string, copies long, turn {turn}, role string, text string")

    def digests(self) -> DataFrame:
        """conv, illegal, cost, audit, repaired_sha256 per conversation."""
        schema = f"conv {self.conv}, share int, piece int, illegal long, head int, tail int, cost long, audit string, repaired_sha256 string, text string"
        kinds = pa.schema([("conv", _arrow(self.conv)), ("share", pa.int32()), ("piece", pa.int32()), ("illegal", pa.int64()), ("head", pa.int32()), ("tail", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("text", pa.string())])

        def run(batches):
            for rows, starts, _, _ in runs(batches):
                made = []
                turns = Turns(rows, starts)
                for i, cost, whole, items in repaired(rows, starts, ("role", "text")):
                    a, b = turns.starts[i], turns.starts[i + 1]
                    row = {"conv": rows.column("conv")[starts[i]].as_py(), "share": rows.column("share")[starts[i]].as_py(), "piece": 0, "illegal": turns.illegal(i), "head": int(turns.code[a]) if b > a else None, "tail": int(turns.code[b - 1]) if b > a else None, "cost": cost, "audit": "", "repaired_sha256": None, "text": None}
                    audit, texts = [], []
                    for e, n, r, x in items:
                        audit.append(e)
                        audit.append("D" * (n - 1))
                        if e != "D":
                            texts.append(f"{r}:{x}")
                    row["audit"] = "".join(audit)
                    if whole:
                        made.append(row | {"repaired_sha256": hashlib.sha256("\n".join(texts).encode()).hexdigest()})
                        continue
                    made.append(row)
                    made += [{"conv": row["conv"], "share": row["share"], "piece": k + 1, "text": x} for k, x in enumerate(pieces(texts))]
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=kinds)

        out = saved(self._with_parts(self.parts, "role", "text").mapInArrow(run, schema))
        whole = out.filter("repaired_sha256 IS NOT NULL").select("conv", "illegal", "cost", "audit", "repaired_sha256")

        def sewn(batches):
            now = object()
            state: dict = {}

            def given():
                return pa.RecordBatch.from_pylist([{"conv": now, "illegal": state["illegal"], "cost": state["cost"], "audit": "".join(state["audit"]), "repaired_sha256": state["digest"].hexdigest()}], schema=pa.schema([kinds.field(c) for c in ("conv", "illegal", "cost", "audit", "repaired_sha256")]))

            for batch in batches:
                for row in batch.to_pylist():
                    if not state or row["conv"] != now:
                        if state:
                            yield given()
                        now, state = row["conv"], {"illegal": 0, "cost": row["cost"], "audit": [], "digest": hashlib.sha256(), "tail": None, "begun": False}
                    if row["piece"] == 0:
                        state["audit"].append(row["audit"])
                        state["illegal"] += row["illegal"]
                        if row["head"] is not None:
                            state["illegal"] += int(state["tail"] is not None and not legal(state["tail"], row["head"]))
                            state["tail"] = row["tail"]
                    else:
                        state["digest"].update((("\n" if state["begun"] else "") + row["text"]).encode())
                        state["begun"] = True
            if state:
                yield given()

        cut = out.filter("repaired_sha256 IS NULL").repartition("conv").sortWithinPartitions("conv", "share", "piece")
        return whole.unionByName(cut.mapInArrow(sewn, f"conv {self.conv}, illegal long, cost long, audit string, repaired_sha256 string"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]


def pieces(texts: list[str]) -> Iterator[str]:
    """Neighbouring texts joined by newlines, about PIECE characters at most."""
    held: list[str] = []
    size = 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= PIECE:
            yield "\n".join(held)
            held, size = [], 0
    if held:
        yield "\n".join(held)


def repaired(rows: pa.RecordBatch, starts: np.ndarray, columns: tuple[str, ...]) -> Iterator[tuple[int, int, bool, list[tuple]]]:
    """(conversation, cost to its end, whether it is whole, its edits) with, for each edit, its letter, copies and the
    turn's columns after it; deleted turns have null role and text."""
    turns = Turns(rows, starts)
    known = {k: rows.column(k) for k in ("end", "last", "entry")}
    size = len(starts) - 1
    at = pa.array(starts[:-1])
    ends = known["end"].take(at).to_pylist()
    whole = np.array([e is None for e in ends], bool)
    last = np.array([True if x is None else x for x in known["last"].take(at).to_pylist()], bool)
    entry = np.array([x or 0 for x in known["entry"].take(at).to_pylist()], np.int64)
    end = np.array([END.tolist() if e is None else e for e in ends], np.int64).reshape(size, 4)
    values = {c: rows.column(c) for c in columns}
    for which in buckets(turns.sizes):
        grid = turns.grid(which)
        costs = backward(*grid, end[which])
        steps = traced(*grid[:4], turns.sizes[which], costs, entry[which], last[which])
        edits: list[list] = [[] for _ in which]
        for who, letter, turn, after in steps:
            for w, c, t, s in zip(who.tolist(), letter.tolist(), turn.tolist(), after.tolist()):
                edits[w].append((chr(c), t, s))
        for w, i in enumerate(which.tolist()):
            items = []
            for edit, turn, state in edits[w]:
                if turn < 0:
                    row = {"turn": None, "role": ROLES[state], "text": ""}
                    items.append((edit, 1, *(row[c] for c in columns)))
                    continue
                place = turns.starts[i] + turn
                source = int(turns.rows[place])
                row = {c: values[c][source].as_py() if c == "turn" or edit != "D" else None for c in columns}
                if edit == "R":
                    row["role"] = ROLES[state]
                items.append((edit, int(turns.n[place]), *(row[c] for c in columns)))
            yield i, int(costs[0, w, entry[i]]), bool(whole[i]), items


def counts(found: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated per conversation."""
    there = F.col("n") > 0
    n = F.when(there, F.col("n")).otherwise(0)
    per = found.groupBy("conv", "turn").agg(
        F.max(there).alias("there"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("must"), n).otherwise(F.greatest(n - 1, F.lit(0)))).alias("duplicate"),
        F.sum(F.when(F.col("cut") & there, 1).otherwise(0)).alias("truncated"),
    )
    turn = F.when(F.col("there"), F.col("turn")).cast("decimal(20,0)")
    gaps = F.coalesce((F.max(turn) - F.min(turn) + 1 - F.count(turn)).try_cast("bigint"), F.lit(0).cast("long"))
    return per.groupBy("conv").agg(gaps.alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged as the hash of their conversation and turn says."""
    named = F.concat(F.coalesce(F.col(f"`{conv}`").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(f"`{turn}`").cast("string"), F.lit(" ")))
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit(" ")), F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    kind = F.crc32(named) % 20
    hurt = F.when(kind == 1, "").when(kind == 2, F.translate(t, ".!?", "")).otherwise(t)
    return rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.when(kind == 4, "user").otherwise(r).alias("role"), hurt.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def audited(rows: DataFrame, **columns) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    repair = Repair(faults(rows, **columns))
    made = repair.digests().withColumnRenamed("conv", "conv_")
    out = repair.counts.join(made, F.col("conv").eqNullSafe(F.col("conv_")))
    return out.select(F.col("conv").alias(columns.get("conv", "conv_id")), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
