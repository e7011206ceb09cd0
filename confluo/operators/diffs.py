"""Operations that turn one snapshot into another. Snapshots are tables keyed by ``keys``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.operators.joins import beside
from confluo.operators.ranks import neighboured
from confluo.session import ship

if TYPE_CHECKING:
    import pyarrow as pa


#: Parts that the sides of a diff are dealt to. Told outright, as sides are far larger sorted or hashed in memory than
#: they are shuffled, by whose size Spark would put many partitions together into one task; up to 200 are written unsorted.
PARTS = 200


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(PARTS, *(F.col(k) for k in keys))


def _both(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join; a side that lacks the key has its ``in_`` flag null."""
    old, new = _dealt(old, keys), _dealt(new, keys)
    left = old.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("in_old"))
    right = new.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("in_new"))
    return left.join(right, keys, "full_outer")


def register_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, newer: Column | None = None) -> DataFrame:
    """A write where the value differs (a missing or null one is a remove), if the change is newer."""
    rows = _both(old, new, keys, [value]).filter(~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")))
    rows = rows if newer is None else rows.filter(newer)
    return rows.select(*keys, F.when(F.col(f"new_{value}").isNull(), "remove").otherwise("upsert").alias("op_type"), F.col(f"new_{value}").alias(value))


def numeric_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, grow_only: bool = False) -> DataFrame:
    """The increment, where there is one."""
    delta = F.coalesce(f"new_{value}", F.lit(0)) - F.coalesce(f"old_{value}", F.lit(0))
    rows = _both(old, new, keys, [value]).select(*keys, delta.alias("delta"))
    return rows.filter("delta > 0" if grow_only else "delta <> 0")


def improvement_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, largest: bool = True) -> DataFrame:
    """Writes that improve a maximum (or minimum); removed keys don't matter."""
    a, b = F.col(f"old_{value}"), F.col(f"new_{value}")
    return _both(old, new, keys, [value]).filter(b.isNotNull() & (a.isNull() | (b > a if largest else b < a))).select(*keys, b.alias(value))


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds and removes of elements; set semantics. A key with a null is equal to none."""
    side = lambda rows, is_new: rows.select(*keys, F.lit(is_new).alias("is_new"))
    rows = _dealt(side(new, True).unionByName(side(old, False)), keys)
    lone = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    found = rows.groupBy(*keys, F.when(lone, F.col("is_new")).alias("lone_")).agg(F.min("is_new").alias("least_"), F.max("is_new").alias("most_"))
    return found.filter(F.col("least_") == F.col("most_")).select(*keys, F.when(F.col("least_"), "upsert").otherwise("remove").alias("op_type"))


def map_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Added, changed and removed entries."""
    rows = _both(old, new, keys, [value])
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")), "changed")
    return rows.select(*keys, kind.alias("change"), F.col(f"old_{value}").alias("before"), F.col(f"new_{value}").alias("after")).filter("change IS NOT NULL")


def vote_diff(old: DataFrame, new: DataFrame, keys: list[str], voter: str, option: str) -> DataFrame:
    """Votes of those who vote now and didn't, or voted differently; withdrawn votes can't be expressed."""
    return _both(old, new, [*keys, voter], [option]).filter(F.col("in_new") & ~F.col(f"old_{option}").eqNullSafe(F.col(f"new_{option}"))).select(*keys, voter, F.col(f"new_{option}").alias(option))


def priority_diff(old: DataFrame, new: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Elements of equal identity whose priority moved, and those added or removed."""
    return map_diff(old, new, keys, priority)


def tree_diff(old: DataFrame, new: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Added, removed and moved nodes; edits of a node's value don't count."""
    out = map_diff(old, new, [node], parent)
    return out.withColumn("change", F.when(F.col("change") == "changed", "moved").otherwise(F.col("change")))


def graph_diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], vertex: list[str], edge: list[str]) -> tuple[DataFrame, DataFrame]:
    return set_diff(old[0], new[0], vertex), set_diff(old[1], new[1], edge)


def slot_diff(old: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """Slots of equal-length arrays that differ."""
    explode = lambda d: d.select(key, F.posexplode(items).alias("slot", "value"))
    return register_diff(explode(old), explode(new), [key, "slot"], "value").select(key, "slot", "value")


def transition_diff(old: DataFrame, new: DataFrame, keys: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Changed states whose transition is in ``allowed`` (from, to); others emit nothing."""
    rows = _both(old, new, keys, [state]).select(*keys, F.col(f"old_{state}").alias("from"), F.col(f"new_{state}").alias(state)).filter(~F.col("from").eqNullSafe(F.col(state)))
    steps = allowed.select(F.col("from").alias("from_"), F.col("to").alias("to_"))
    return rows.join(steps, (F.col("from").eqNullSafe(F.col("from_"))) & (F.col(state) == F.col("to_"))).select(*keys, "from", F.col(state).alias("to"))


def flattened(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, path, value as text) of a document's scalar fields, nested ones by dotted names; a struct is a row of
    its own, whose value only says whether it is there."""
    parts = []

    def add(path: str, at: Column, type_: T.DataType) -> None:
        if isinstance(type_, T.StructType):
            parts.append((path, F.when(at.isNotNull(), "{}"), True))
            for f in type_.fields:
                add(f"{path}.{f.name}", at.getField(f.name), f.dataType)
        else:
            parts.append((path, at.cast("string"), False))

    for f in fields:
        add("$." + f, F.col(f), docs.schema[f].dataType)
    rows = F.array(*(F.struct(F.lit(p).alias("path"), v.alias("value"), F.lit(nested).alias("nested")) for p, v, nested in parts))
    return docs.select(key, F.inline(rows))


def object_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Recursive diff of documents: one write per scalar path that differs. A parent that became null is one remove,
    not one per child; one that appears is given by its children."""
    sides = [flattened(x, key, fields) for x in (old, new)]
    both = _both(sides[0], sides[1], [key, "path"], ["value", "nested"])
    changed = both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    nested = F.coalesce("new_nested", "old_nested")
    gone = changed.filter(nested & F.col("new_value").isNull()).select(key, F.col("path").alias("above"))
    rows = changed.filter(~nested | F.col("new_value").isNull())
    parents = [".".join(p.split(".")[:n]) for p in sorted(_paths(old, fields)) for n in range(2, p.count(".") + 1)]
    if parents:
        below = rows.withColumn("above", F.explode_outer(F.filter(F.array(*map(F.lit, sorted(set(parents)))), lambda a: F.col("path").startswith(F.concat(a, F.lit("."))))))
        hidden = below.join(gone, [key, "above"], "left_semi").select(key, "path").distinct()
        rows = rows.join(hidden, [key, "path"], "left_anti")
    return rows.select(key, "path", F.when(F.col("new_value").isNull(), "remove").otherwise("upsert").alias("op_type"), F.col("new_value").alias("value"))


def _paths(docs: DataFrame, fields: list[str]) -> list[str]:
    out = []

    def add(path: str, type_: T.DataType) -> None:
        out.append(path)
        if isinstance(type_, T.StructType):
            for f in type_.fields:
                add(f"{path}.{f.name}", f.dataType)

    for f in fields:
        add("$." + f, docs.schema[f].dataType)
    return out


def decorated(ops: DataFrame, epochs: DataFrame) -> DataFrame:
    """A diff's operations as an epoch-bound property takes them: in the epoch (document_id, path, epoch) that their property
    is in now, the first where it has none, so that a diff goes on in the current epoch and opens no other."""
    at = ["document_id", "path"]
    now = epochs.groupBy(*at).agg(F.max("epoch").alias("now_"))
    return beside(ops, now, at).withColumn("epoch", F.coalesce("now_", F.lit(0)).cast("long")).drop("now_")


def clocked(ops: DataFrame, base: DataFrame, order: list[str]) -> DataFrame:
    """Local and global clocks for new operations: consecutive after what each replica has issued, from
    base (replica_id, clock, global_clock)."""
    n = F.row_number().over(Window.partitionBy("replica_id").orderBy(*order))
    rows = ops.withColumn("n", n).join(base.select("replica_id", F.col("clock").alias("c"), F.col("global_clock").alias("g")), "replica_id", "left")
    return rows.withColumns({"clock": F.coalesce("c", F.lit(0)) + F.col("n"), "global_clock": F.coalesce("g", F.lit(0)) + F.col("n")}).drop("n", "c", "g")


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Indices of one longest common subsequence, by Myers' middle snakes: time grows with length times
    difference, memory with length."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, left, right = todo.pop()
        while low < high and left < right and a[low] == b[left]:
            out.append((low, left))
            low, left = low + 1, left + 1
        while low < high and left < right and a[high - 1] == b[right - 1]:
            high, right = high - 1, right - 1
            out.append((high, right))
        if low < high and left < right:
            x, y = middle(a, low, high, b, left, right)
            todo += [(low, x, left, y), (x, high, y, right)]
    return sorted(out)


def middle(a: list, low: int, high: int, b: list, left: int, right: int) -> tuple[int, int]:
    """A place that a shortest edit path from (low, left) to (high, right) goes through, neither of its ends;
    the first and last elements differ. Furthest places are kept per diagonal, from both ends, until they meet."""
    n, m = high - low, right - left
    delta, most = n - m, (n + m + 1) // 2
    ahead, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            while x < n and y < m and x >= 0 <= y and a[low + x] == b[left + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + back[delta - k] >= n and 0 <= y <= m and x <= n:
                return low + x, left + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            while x < n and y < m and x >= 0 <= y and a[high - 1 - x] == b[right - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if delta % 2 == 0 and abs(delta - k) <= d and x + ahead[delta - k] >= n and 0 <= y <= m and x <= n:
                return high - x, right - y
    raise AssertionError("edit paths always meet")


#: Edits that a task holds before it hands them on.
EDITS = 10_000


def edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of (key, old, new) rows. Only one pair at a time is made of Python values, and edits are handed on as they
    come, so a task's memory doesn't depend on how many pairs it has."""
    import pyarrow as pa

    names, types = ["key", "op_type", "place", "value"], [pa.string(), pa.string(), pa.int32(), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    for batch in batches:
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            k, a, b = (batch.column(j)[i].as_py() for j in range(3))
            a, b = a or [], b or []
            kept = lcs_pairs(a, b)
            left, right = {i for i, _ in kept}, {j for _, j in kept}
            rows += [(k, "remove", i, x) for i, x in enumerate(a) if i not in left]
            rows += [(k, "upsert", j, x) for j, x in enumerate(b) if j not in right]
            if len(rows) >= EDITS:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)


def sequence_diff(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """Removes (by old place) and inserts (by new place) between two lists per row, by longest common
    subsequence; runs batch-wise in Python, as no built-in operator aligns sequences."""
    ship(pairs.sparkSession)
    given = pairs.select(F.col(key).cast("string").alias("key"), F.col(old).cast("array<string>"), F.col(new).cast("array<string>"))
    return given.mapInArrow(edit_batches, "key string, op_type string, place int, value string").withColumnRenamed("key", key)


def predecessors(items: DataFrame, keys: list[str], order: str, id_: str = "id") -> DataFrame:
    """The left pointer of each element for an insert-after list: its predecessor's id, null at the start."""
    return items.withColumn("left_id", F.lag(id_).over(Window.partitionBy(*keys).orderBy(order)))


#: Fixed value: the digits of one level of a path id.
LEVEL = 32


def path_between(low: Column, high: Column) -> Column:
    """A digit path between two others (arrays of ints below LEVEL, ``low`` < ``high``, null: open): the digits
    that both share, then a digit between theirs, or, where none is, low's digits and a new level in its middle."""
    empty = F.array().cast("array<int>")
    a, b = F.coalesce(low, empty), high
    digit = lambda x, i, other: F.coalesce(F.get(x, i), F.lit(other))
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.coalesce(F.size(b), F.lit(0))))
    top = lambda i: F.when(b.isNull(), F.lit(LEVEL)).otherwise(digit(b, i, 0))
    # the first place where they differ
    differs = F.filter(places, lambda i: digit(a, i, 0) != top(i))
    at = F.get(differs, 0)
    near, far = digit(a, at, 0), top(at)
    prefix = F.transform(F.sequence(F.lit(0), at), lambda i: digit(a, i, 0))
    room = F.concat(F.slice(prefix, F.lit(1), at), F.array(F.floor((near + far) / 2).cast("int")))
    # no digit between: keep low, and go on above the rest of it
    rest = F.slice(a, at + 2, F.greatest(F.size(a) - at - 1, F.lit(0)))
    free = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.size(rest)), lambda i: digit(rest, i, 0) < LEVEL - 1), 0), F.size(rest))
    lower = digit(rest, free, 0)
    deeper = F.concat(prefix, F.slice(rest, F.lit(1), free), F.array(F.ceil((lower + LEVEL) / 2).cast("int")))
    return F.when(far - near > 1, room).otherwise(deeper)


def positions_between(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A position for a new element before each item: halfway to its predecessor, or one before the first."""
    near = neighboured(items, keys, order, {"before": "position"})
    return near.withColumn("between", (F.col("position") + F.coalesce("before", F.col("position") - 2)) / 2).drop("before")
