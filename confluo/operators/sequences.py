"""Lists: their order from insert-after pointers, and what an index refers to.

Document order of an insert-after list is a depth-first walk. A short list is walked in one task with many others. A
long one is a list ranking: every node is entered and left once, what comes before each entry or exit follows from its
parent, its siblings and its children, and an entry's place is the number of entries up to it. Nodes get dense numbers
and are range partitioned by them; a partition follows its own pointers in numpy, by doubling, and only pointers that
leave a partition are followed by joins, by doubling again. Text that was typed one character after the other stays
within its partition, so that few pointers are left; but nothing depends on that.

An index of a replica's edit refers to the list as that replica has it: the folded list, changed by its own edits before.
Those are kept as pieces, runs of the folded list and elements of its own, so that a task holds the edits of a
replica, not the list; what is at a place of the folded list is then a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Context, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.operators.joins import beside, hot_keys
from confluo.operators.ranks import neighboured, ranked
from confluo.session import saved, ship

#: Nodes of a list that one task walks at most; longer lists are ranked.
WALKED = 50_000


def rga_order(nodes: DataFrame, *, by: str = "document_id") -> DataFrame:
    """Place of each node of its list, newest sibling first, an unknown left neighbour being the start; nodes that
    hang on a cycle have none. nodes: by, id and left_id (longs, or keys such as ``keys.of_id``), deleted. Ids that
    occur twice are one node, deleted if one of them is."""
    kind = nodes.schema["id"].dataType.simpleString()
    rows = nodes.select(F.col(by).cast("string").alias(by), "id", F.col("left_id").cast(kind).alias("left_id"), F.col("deleted").cast("boolean").alias("deleted"))
    long = saved(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WALKED).select(by))
    if long.isEmpty():
        return walked(rows, by)
    marked = beside(rows, long.withColumn("long_", F.lit(True)), [by])
    short = walked(marked.filter("long_ IS NULL").drop("long_"), by)
    return short.unionByName(tour_ranked(marked.filter("long_").drop("long_"), by))


def walked(rows: DataFrame, by: str) -> DataFrame:
    """``rga_order`` of lists that fit a task; a batch holds many of them."""
    import pyarrow as pa

    kind = rows.schema["id"].dataType.simpleString()
    type_ = pa.string() if kind == "string" else pa.int64()

    def walk(ids: list, lefts: list, gone: list) -> tuple[list, list]:
        left, dead = {}, {}
        for i, above, g in zip(ids, lefts, gone):
            left[i] = min(left[i], above) if left.get(i) is not None and above is not None else left.get(i, above)
            dead[i] = dead.get(i, False) or bool(g)
        below: dict = {}
        for i, above in left.items():
            below.setdefault(above if above in left else None, []).append(i)
        out, stack = [], sorted(below.get(None, []))
        while stack:
            i = stack.pop()
            out.append(i)
            stack.extend(sorted(below.get(i, [])))
        return out, [dead[i] for i in out]

    def run(batches):
        now, held = None, ([], [], [])
        out = ([], [], [], [])

        def close():
            ids, gone = walk(*held)
            out[0].extend([now] * len(ids))
            out[1].extend(ids)
            out[2].extend(range(1, len(ids) + 1))
            out[3].extend(gone)
            for x in held:
                x.clear()

        def given():
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], type_), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_())], [by, "id", "place", "deleted"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            for doc, i, left, gone in zip(*(batch.column(c).to_pylist() for c in (by, "id", "left_id", "deleted"))):
                if held[0] and doc != now:
                    close()
                now = doc
                for x, v in zip(held, (i, left, gone)):
                    x.append(v)
            if len(out[0]) > 10_000:
                yield given()
        if held[0]:
            close()
        yield given()

    return rows.repartition(by).sortWithinPartitions(by).mapInArrow(run, f"`{by}` string, id {kind}, place int, deleted boolean")


#: Before the first entry of a list, and before what no list reaches.
START, NOWHERE = -1, -2


def followed(before, entries):
    """Pointers of a partition's own arcs (-1 or -2 where they leave it, by index else) by doubling: for each arc the
    first arc of its run, and the entries from there up to it; -1 where the run is a cycle."""
    import numpy as np

    first, count, pointer = np.arange(len(before)), entries.astype(np.int64), before.copy()
    for _ in range(max(len(before), 1).bit_length() + 1):
        on = np.flatnonzero(pointer >= 0)
        if not len(on):
            break
        to = pointer[on]
        count[on], first[on], pointer[on] = count[on] + count[to], first[to], pointer[to]
    first[pointer >= 0] = -1
    return first, count


def tour_ranked(rows: DataFrame, by: str) -> DataFrame:
    """``rga_order`` of lists of any length, by list ranking over the tour of entries and exits."""
    import numpy as np
    import pyarrow as pa

    ship(rows.sparkSession)
    once = rows.groupBy(by, "id").agg(F.min("left_id").alias("left_id"), F.max("deleted").alias("deleted"))
    nodes = saved(ranked(once, [], [by, "id"], "num"))
    above = nodes.select(F.col(by).alias("by_"), F.col("id").alias("id_"), F.col("num").alias("parent"))
    placed = saved(nodes.join(above, (F.col(by) == F.col("by_")) & (F.col("left_id") == F.col("id_")), "left").select(by, "id", "deleted", "num", F.coalesce("parent", F.lit(START).cast("long")).alias("parent")))
    # newest first: the sibling before is the next higher number, the last child the lowest
    near = neighboured(placed, [by, "parent"], ["num"], {"higher": "num"}, step=1)
    last = placed.filter(F.col("parent") >= 0).groupBy(F.col("parent").alias("num_")).agg(F.min("num").alias("last"))
    linked = near.join(last, F.col("num") == F.col("num_"), "left").drop("num_")
    entry, left = F.col("num") * 2, F.col("num") * 2 + 1
    before_entry = F.coalesce(F.col("higher") * 2 + 1, F.when(F.col("parent") >= 0, F.col("parent") * 2), F.lit(START).cast("long"))
    arcs = linked.select(by, "id", "deleted", "num", before_entry.alias("before_entry"), F.coalesce(F.col("last") * 2 + 1, entry).alias("before_exit"))
    dealt = saved(arcs.repartitionByRange("num").sortWithinPartitions("num"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]  # a partition's nodes, some numbers each
        if not held:
            return
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        num, entries, exits = (part.column(c).to_numpy(zero_copy_only=False) for c in ("num", "before_entry", "before_exit"))
        before = np.stack([entries, exits], axis=1).ravel()
        at = np.searchsorted(num, before >> 1)
        mine = (before >= 0) & (num[np.minimum(at, len(num) - 1)] == before >> 1)
        first, count = followed(np.where(mine, 2 * at + (before & 1), -1), np.tile([1, 0], len(num)))
        anchor = np.where(first >= 0, before[first], NOWHERE)
        names = ["entry_anchor", "entry_count", "exit_anchor", "exit_count"]
        values = [anchor[0::2], count[0::2], anchor[1::2], count[1::2]]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (by, "id", "deleted", "num")), *map(pa.array, values)], [by, "id", "deleted", "num", *names])

    kind = rows.schema["id"].dataType.simpleString()
    local = saved(dealt.mapInArrow(run, f"`{by}` string, id {kind}, deleted boolean, num long, entry_anchor long, entry_count long, exit_anchor long, exit_count long"))
    needed = local.select(F.explode(F.array("entry_anchor", "exit_anchor")).alias("arc")).filter(F.col("arc") >= 0).distinct()
    sides = local.select(F.inline(F.array(F.struct(entry.alias("arc"), F.col("entry_anchor").alias("anchor"), F.col("entry_count").alias("count")), F.struct(left.alias("arc"), F.col("exit_anchor").alias("anchor"), F.col("exit_count").alias("count")))))
    open_ = saved(sides.join(needed, "arc", "left_semi"))
    for _ in range(max(open_.count(), 1).bit_length() + 1):
        if open_.filter(F.col("anchor") >= 0).isEmpty():
            break
        jump = open_.select(F.col("arc").alias("anchor"), F.col("anchor").alias("next"), F.col("count").alias("more"))
        open_ = saved(open_.join(jump, "anchor", "left").select("arc", F.coalesce("next", "anchor").alias("anchor"), (F.col("count") + F.coalesce("more", F.lit(0))).alias("count")))
    totals = open_.filter(F.col("anchor") == START).select(F.col("arc").alias("entry_anchor"), F.col("count").alias("before"))
    out = beside(local, totals, ["entry_anchor"]).filter((F.col("entry_anchor") == START) | F.col("before").isNotNull())
    return out.select(by, "id", (F.col("entry_count") + F.coalesce("before", F.lit(0))).cast("int").alias("place"), "deleted")


# indices


class Pieces:
    """A list as runs of an older list (start, length) and new elements (name, None), in blocks of BLOCK pieces."""

    BLOCK = 512

    def __init__(self, length: int):
        self.blocks: list[list[tuple]] = [[(0, length)] if length else []]
        self.sizes = [length]

    def __len__(self) -> int:
        return sum(self.sizes)

    def _found(self, index: int) -> tuple[int, int, int]:
        """(block, piece, offset) of an index below the length."""
        b = 0
        while index >= self.sizes[b]:
            index -= self.sizes[b]
            b += 1
        for p, (_, n) in enumerate(self.blocks[b]):
            n = 1 if n is None else n
            if index < n:
                return b, p, index
            index -= n
        raise IndexError(index)

    def at(self, index: int) -> tuple[int | None, str | None]:
        """(place in the older list, None) or (None, name of a new element)."""
        b, p, offset = self._found(index)
        start, n = self.blocks[b][p]
        return (None, start) if n is None else (start + offset, None)

    def _put(self, b: int, p: int, old: int, pieces: list[tuple], more: int) -> None:
        block = self.blocks[b]
        block[p : p + old] = pieces
        self.sizes[b] += more
        if len(block) > 2 * self.BLOCK:
            half = block[self.BLOCK :]
            self.blocks[b] = block[: self.BLOCK]
            size = sum(1 if n is None else n for _, n in half)
            self.blocks.insert(b + 1, half)
            self.sizes[b : b + 1] = [self.sizes[b] - size, size]

    def insert(self, index: int, name: str) -> None:
        if index == len(self):
            self._put(len(self.blocks) - 1, len(self.blocks[-1]), 0, [(name, None)], 1)
            return
        b, p, offset = self._found(index)
        start, n = self.blocks[b][p]
        if offset == 0:
            self._put(b, p, 0, [(name, None)], 1)
        else:
            self._put(b, p, 1, [(start, offset), (name, None), (start + offset, n - offset)], 1)

    def remove(self, index: int) -> None:
        b, p, offset = self._found(index)
        start, n = self.blocks[b][p]
        rest = [] if n is None else [(start, offset), (start + offset + 1, n - offset - 1)]
        self._put(b, p, 1, [r for r in rest if r[1]], -1)


#: Columns that say who edits which list.
EDITOR = ["document_id", "path", "replica_id"]


def listed_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows as ``to_pylist`` gives them, of texts, numbers and booleans, column by column."""

    def values(column: pa.Array) -> list:
        if column.null_count == 0 or column.type == "string":
            return column.to_numpy(zero_copy_only=False).tolist()
        out = column.fill_null(False if column.type == "bool" else 0).to_numpy(zero_copy_only=False).astype(object)
        out[column.is_null().to_numpy(zero_copy_only=False)] = None
        return out.tolist()

    return (dict(zip(batch.schema.names, row)) for row in zip(*map(values, batch.columns)))


def _in_order(edits: DataFrame, start: Callable[[dict], object], step: Callable[[object, dict], dict], columns: list[str], schema: str, kinds: dict) -> DataFrame:
    """``step`` over the edits of each editor in order of its clock, with what ``start`` makes for each editor. Edits
    are streamed; only what the editor's state holds is in memory."""
    import pyarrow as pa

    ship(edits.sparkSession)
    fields = pa.schema(list(kinds.items()))

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for row in listed_rows(batch):
                who = tuple(row[c] for c in EDITOR)
                if who != now:
                    now, state = who, start(row)
                out.append(step(state, row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    return edits.select(*columns).repartition(*EDITOR).sortWithinPartitions(*EDITOR, "clock").mapInArrow(run, schema)


def located(edits: DataFrame) -> DataFrame:
    """What each edit's index refers to. edits: EDITOR, clock, tag (of the edit, the new element's name), intent (add,
    insert or remove), index, length (of the folded list). Result: EDITOR, clock, tag with left and right neighbour of
    an insert or the target of a remove, each as a place from 1 in the folded list or the tag of an element of the
    editor's own, and ``problem``: an index outside the list, which changes nothing."""
    import pyarrow as pa

    def step(pieces: Pieces, row: dict) -> dict:
        out = {c: row[c] for c in (*EDITOR, "clock", "tag")}
        n, index = len(pieces), row["index"]
        index = n if row["intent"] == "add" else index
        if index is None or index < 0 or index > n - (row["intent"] == "remove"):
            return out | {"problem": "index out of range"}
        place = lambda i: (lambda p, t: (None if p is None else p + 1, t))(*pieces.at(i))
        if row["intent"] == "remove":
            out["target_place"], out["target_tag"] = place(index)
            pieces.remove(index)
            return out
        if index > 0:
            out["left_place"], out["left_tag"] = place(index - 1)
        if index < n:
            out["right_place"], out["right_tag"] = place(index)
        pieces.insert(index, row["tag"])
        return out

    names = [f"{w}_{k}" for w in ("left", "right", "target") for k in ("place", "tag")]
    kinds = {c: pa.string() for c in EDITOR} | {"clock": pa.int64(), "tag": pa.string()} | {n: pa.int64() if n.endswith("place") else pa.string() for n in names} | {"problem": pa.string()}
    schema = ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in kinds.items())
    return _in_order(edits, lambda row: Pieces(int(row["length"] or 0)), step, [*EDITOR, "clock", "tag", "intent", "index", "length"], schema, kinds)


#: Fixed value: positions of one level of a path id lie below this.
LEVEL = 32
#: Fixed value: significant digits of a fraction between two positions.
DECIMALS = Context(prec=29)


def fraction_key(x: Decimal) -> str:
    """A position that isn't negative, as ``keys.of_number`` writes numbers, but with all of its fraction."""
    whole, _, rest = format(x, "f").partition(".")
    return "1" + whole.zfill(28) + "." + rest.rstrip("0").ljust(10, "0")


def fraction_between(low: str | None, high: str | None, replica: str) -> str:
    """Halfway, or one more than the last; equal positions are told apart by their tags."""
    read = lambda k: Decimal(k[1:])
    a = read(low) if low is not None else Decimal(0)
    if high is None:
        return fraction_key(DECIMALS.add(a, Decimal(1)))
    b = read(high)
    return low if b <= a else fraction_key(DECIMALS.divide(DECIMALS.add(a, b), Decimal(2)))


def path_parts(key: str | None) -> list[tuple[int, str]]:
    return [(int(p[:16], 16) - 2**63, p[16:]) for p in (key or "").split("\0")[:-1]]


def path_key(parts: list[tuple[int, str]]) -> str:
    """As ``keys.of_path`` writes it, of replica ids that are escaped already."""
    return "".join(f"{n + 2**63:016x}{r}\0" for n, r in parts)


def path_key_between(low: str | None, high: str | None, replica: str) -> str:
    """The first position after ``low`` on the first level that has one before ``high``, with the replica's name."""
    a, b = path_parts(low), path_parts(high)
    name = replica.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01")
    level = 0
    while (b[level][0] if level < len(b) else LEVEL) - (a[level][0] if level < len(a) else 0) <= 1:
        level += 1
    shared = (a + [(0, "")] * level)[:level]
    return path_key([*shared, ((a[level][0] if level < len(a) else 0) + 1, name)])


BETWEEN = {"array_lcs": fraction_between, "lseq": path_key_between}


def positioned(found: DataFrame) -> DataFrame:
    """``pos`` for the edits of ``located``, with left_pos, right_pos and target_pos of the folded list's elements: an insert's
    lies between the positions of both neighbours, in order, as a neighbour may be the editor's own; a remove's is its target's.
    ``strategy`` says how positions are made; insert-after lists have none."""
    import pyarrow as pa

    def step(mine: dict, row: dict) -> dict:
        out = {c: row[c] for c in (*EDITOR, "clock", "tag")} | {"pos": None}
        between = BETWEEN.get(row["strategy"])
        if between is None:
            return out
        if row["inserts"]:
            low = mine[row["left_tag"]] if row["left_tag"] is not None else row["left_pos"]
            high = mine[row["right_tag"]] if row["right_tag"] is not None else row["right_pos"]
            out["pos"] = mine[row["tag"]] = between(low, high, row["replica_id"])
        else:
            out["pos"] = mine[row["target_tag"]] if row["target_tag"] is not None else row["target_pos"]
        return out

    kinds = {c: pa.string() for c in EDITOR} | {"clock": pa.int64(), "tag": pa.string(), "pos": pa.string()}
    schema = ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in kinds.items())
    return _in_order(found, lambda row: {}, step, [*EDITOR, "clock", "tag", "strategy", "inserts", "left_tag", "right_tag", "target_tag", "left_pos", "right_pos", "target_pos"], schema, kinds)


def elements_at(rows: DataFrame, elements: DataFrame, sides: list[str]) -> DataFrame:
    """``rows`` with the elements at their ``<side>_place``: ``<side>_id`` and, if elements have one, ``<side>_pos``.
    elements: document_id, path, place, id[, pos]. Only places that are asked for go to the join."""
    names = [c for c in ("id", "pos") if c in elements.columns]
    at = ["document_id", "path", "place"]
    places = rows.select("document_id", "path", F.explode(F.array(*(f"{s}_place" for s in sides))).alias("place")).filter("place IS NOT NULL")
    hot = hot_keys(places, at)
    asked = places.distinct()
    found = saved(asked.join(elements.select("document_id", "path", F.col("place").cast("long").alias("place"), *names), at))
    size = found.count()
    for s in sides:
        one = found.select("document_id", "path", F.col("place").alias(f"{s}_place"), *(F.col(c).alias(f"{s}_{c}") for c in names))
        rows = beside(rows, one, ["document_id", "path", f"{s}_place"], size=size, hot=lambda s=s: hot.withColumnRenamed("place", f"{s}_place"))
    return rows
