"""Converged state of each strategy: a fold of the operation log per document and path.

Every fold is an aggregate that doesn't depend on the order of its input, except where the strategy
itself does; those fold in order of arrival and say so. All take a log in the shape of
``confluo.sources.oplog.SCHEMA`` and group by ``BY`` (and the key, element or voter).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions import values
from confluo.functions.ordering import clamp
from confluo.operators.joins import beside
from confluo.operators.ranks import ranked
from confluo.operators.sequences import rga_order  # noqa: F401
from confluo.session import saved


BY = ("document_id", "path")


def upserts() -> Column:
    return F.col("op_type") == "upsert"


def removes() -> Column:
    return F.col("op_type") == "remove"


def amounts() -> Column:
    """Operations that a counter takes: increments, which a log may write as upserts. Removes fail there."""
    return F.col("op_type").isin("increment", "upsert")


def clears() -> Column:
    """Operations that reset a first-writer-wins property: a remove of kind clear, or one that names nothing."""
    names = [F.col(c).isNull() for c in ("key", "num", "str")]
    return removes() & (F.coalesce(F.col("kind") == "clear", F.lit(False)) | (names[0] & names[1] & names[2]))


def since_reset(ops: DataFrame, reset: Column | None = None) -> DataFrame:
    """Operations that arrived after their property's last reset, without resets. Two phases: the last reset of each
    property, a row each, then a join that is bounded by their number."""
    reset = clears() if reset is None else reset
    last = ops.filter(reset).groupBy(*BY).agg(F.max("arrival").alias("last"))
    return beside(ops, last, list(BY)).filter(F.col("last").isNull() | (F.col("arrival") > F.col("last"))).drop("last").filter(~F.coalesce(reset, F.lit(False)))


def _winner(ops: DataFrame, by: tuple[str, ...], pick: Callable[[Column], Column], *columns: str) -> DataFrame:
    """The row that ``pick`` picks by the total order, with the given columns and, as ``value``, its typed value."""
    won = pick(F.struct("ts", "replica_id", "global_clock", "op_type", *columns, values.payload(ops).alias("value"))).alias("won")
    return ops.groupBy(*by).agg(won).select(*by, "won.*")


# registers


def lww_register(ops: DataFrame) -> DataFrame:
    """Newest write, of any type; a winning remove leaves null."""
    return _winner(ops, BY, F.max, "num").withColumns({c: F.when(upserts(), F.col(c)) for c in ("num", "value")})


def fww_register(ops: DataFrame, reset: Column | None = None) -> DataFrame:
    """Oldest operation since the last reset in order of arrival; if that removes a value, null."""
    return _winner(since_reset(ops, reset), BY, F.min, "num").withColumns({c: F.when(upserts(), F.col(c)) for c in ("num", "value")})


def max_wins(ops: DataFrame) -> DataFrame:
    """Largest value written, compared by type; removes fail."""
    return ops.filter(upserts()).groupBy(*BY).agg(F.max("num").alias("num"), F.max(values.payload(ops)).alias("value"))


def min_wins(ops: DataFrame) -> DataFrame:
    return ops.filter(upserts()).groupBy(*BY).agg(F.min("num").alias("num"), F.min(values.payload(ops)).alias("value"))


def average_register(ops: DataFrame) -> DataFrame:
    """Mean over replicas of each replica's newest contribution; removes fail."""
    mine = ops.filter(upserts()).groupBy(*BY, "replica_id").agg(F.max(F.struct("ts", "global_clock", "num")).alias("won"))
    return mine.groupBy(*BY).agg((F.sum("won.num").cast("double") / F.count(F.lit(1))).alias("average"), F.count(F.lit(1)).alias("replicas"))


def fixed_size_array(ops: DataFrame, size: int, index: Column) -> DataFrame:
    """Newest write per slot; slots nobody wrote hold 0."""
    slots = _winner(ops.withColumn("slot", index), (*BY, "slot"), F.max, "num").filter(F.col("slot") < size)
    every = ops.select(*BY).distinct().select(*BY, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    return every.join(slots.select(*BY, "slot", "num"), [*BY, "slot"], "left").select(*BY, "slot", F.coalesce("num", F.lit(0).cast("decimal(18,2)")).alias("num"))


def state_machine(ops: DataFrame, target: Column, allowed: Callable[[Column, Column], Column], start: str) -> DataFrame:
    """In order of arrival per document: an invalid transition is rejected before the timestamp counts,
    then the newest timestamp wins. Order-dependent, so the transitions of one document are one array."""
    moves = ops.withColumn("to", target).groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("arrival", "global_clock", "ts", "replica_id", "to"))).alias("moves"))
    begin = F.struct(F.lit(start).alias("state"), F.lit(None).cast("bigint").alias("ts"), F.lit(0).alias("rejected"))

    def step(s: Column, m: Column) -> Column:
        valid = allowed(s["state"], m["to"])
        newer = s["ts"].isNull() | (m["ts"] > s["ts"])
        return F.struct(F.when(valid & newer, m["to"]).otherwise(s["state"]).alias("state"), F.when(valid & newer, m["ts"]).otherwise(s["ts"]).alias("ts"), (s["rejected"] + F.when(valid, 0).otherwise(1)).alias("rejected"))

    return moves.select(*BY, F.aggregate("moves", begin, step).alias("s")).select(*BY, "s.state", "s.rejected")


# counters


def counter(ops: DataFrame) -> DataFrame:
    """The sum of all increments; removes fail and add nothing."""
    return ops.filter(amounts()).groupBy(*BY).agg(F.sum("num").alias("num"))


def g_counter(ops: DataFrame) -> DataFrame:
    """Only growth counts; anything else is a failed operation."""
    grows = amounts() & F.coalesce(F.col("num") > 0, F.lit(False))
    return ops.groupBy(*BY).agg(F.sum(F.when(grows, F.col("num"))).alias("num"), F.sum(F.when(grows, 0).otherwise(1)).alias("failed"))


def bounded_counter(ops: DataFrame, low, high) -> DataFrame:
    """The unbounded sum is state; what is shown is clamped."""
    return counter(ops).withColumn("shown", clamp(F.col("num").cast("double"), float(low), float(high)))


def bounded_counter_history(ops: DataFrame, low, high) -> DataFrame:
    """Shown value after each increment of a replica, in order of its clock."""
    ops = ops.filter(amounts())
    w = Window.partitionBy(*BY, "replica_id").orderBy("clock").rowsBetween(Window.unboundedPreceding, 0)
    return ops.select(*BY, "replica_id", "clock", clamp(F.sum("num").over(w).cast("double"), float(low), float(high)).alias("shown"))


def counter_map(ops: DataFrame) -> DataFrame:
    up, down = F.sum(F.when(F.col("num") > 0, F.col("num")).otherwise(0)), F.sum(F.when(F.col("num") < 0, -F.col("num")).otherwise(0))
    return ops.filter(amounts()).groupBy(*BY, "key").agg(up.alias("p"), down.alias("n")).withColumn("num", F.col("p") - F.col("n"))


# maps


def lww_map(ops: DataFrame) -> DataFrame:
    """Newest operation per key, removes included; keys whose newest is a remove are absent."""
    return _winner(ops, (*BY, "key"), F.max, "num").filter(upserts())


def fww_map(ops: DataFrame) -> DataFrame:
    """Oldest operation per key since the last reset of the whole map."""
    return _winner(since_reset(ops), (*BY, "key"), F.min, "num").filter(upserts())


def max_wins_map(ops: DataFrame) -> DataFrame:
    return ops.filter(upserts()).groupBy(*BY, "key").agg(F.max("num").alias("num"), F.max(values.payload(ops)).alias("value"))


def min_wins_map(ops: DataFrame) -> DataFrame:
    return ops.filter(upserts()).groupBy(*BY, "key").agg(F.min("num").alias("num"), F.min(values.payload(ops)).alias("value"))


def or_map(ops: DataFrame, removed: DataFrame) -> DataFrame:
    """A key lives while one of its add tags isn't removed; its value is the newest write."""
    live = or_set(ops, removed)
    return live.join(_winner(ops.filter(upserts()), (*BY, "key"), F.max, "num").drop("op_type"), [*BY, "key"])


# sets (elements are in key)


def g_set(ops: DataFrame) -> DataFrame:
    return ops.filter(upserts()).select(*BY, "key").distinct()


def two_phase_set(ops: DataFrame) -> DataFrame:
    """Added and never removed, whatever came first."""
    return ops.groupBy(*BY, "key").agg(F.bool_or(upserts()).alias("added"), F.bool_or(removes()).alias("gone")).filter("added AND NOT gone").select(*BY, "key")


def _add_remove(ops: DataFrame, pick: Callable[[Column], Column]) -> DataFrame:
    o = F.struct("ts", "replica_id")
    return ops.groupBy(*BY, "key").agg(pick(F.when(upserts(), o)).alias("added"), pick(F.when(removes(), o)).alias("gone"))


def lww_set(ops: DataFrame) -> DataFrame:
    """Live while the newest add is newer than the newest remove; a tie removes."""
    return _add_remove(ops, F.max).filter("added IS NOT NULL AND (gone IS NULL OR added > gone)").select(*BY, "key")


def fww_set(ops: DataFrame) -> DataFrame:
    """Live while the oldest add is no newer than the oldest remove, both since the last reset; a tie adds."""
    return _add_remove(since_reset(ops), F.min).filter("added IS NOT NULL AND (gone IS NULL OR added <= gone)").select(*BY, "key")


def observed_tags(ops: DataFrame) -> DataFrame:
    """Tags that removes have observed: those that the same replica added to the element before. With the newest remove that
    did: remover and removed_clock."""
    at = [*BY, "key", "replica_id"]
    last = ops.filter(removes()).groupBy(*at).agg(F.max("clock").alias("last"))
    return ops.filter(upserts()).join(last, at).filter("clock < last").select(*BY, "key", "tag", F.col("replica_id").alias("remover"), F.col("last").alias("removed_clock"))


def or_set(ops: DataFrame, removed: DataFrame) -> DataFrame:
    """Live while an add tag isn't among the removed (document_id, path, key, tag)."""
    return ops.filter(upserts()).join(removed, [*BY, "key", "tag"], "left_anti").select(*BY, "key").distinct()


def _live_with_value(ops: DataFrame) -> DataFrame:
    newest = _winner(ops.filter(upserts()), (*BY, "key"), F.max, "num").select(*BY, "key", "num", "value")
    return lww_set(ops).join(newest, [*BY, "key"])


def sorted_set(ops: DataFrame) -> DataFrame:
    """The live elements of an LWW set with their newest value, ranked by value, then text."""
    return ranked(_live_with_value(ops), list(BY), [F.asc_nulls_first("value"), F.asc("key")]).withColumn("rank", F.col("rank").cast("int"))


def priority_queue(ops: DataFrame, top: int | None = None) -> DataFrame:
    """Live elements by descending priority; ``top`` keeps the first few of each queue."""
    out = ranked(_live_with_value(ops), list(BY), [F.desc("value"), F.asc("key")]).withColumn("rank", F.col("rank").cast("int"))
    return out if top is None else out.filter(F.col("rank") <= top)


# votes and decorators


def vote_counter(votes: DataFrame) -> DataFrame:
    """Each replica's newest vote (in key) counts once; options without votes are gone."""
    return votes.groupBy(*BY, "replica_id").agg(F.max(F.struct("ts", "global_clock", "key")).alias("won")).groupBy(*BY, F.col("won.key").alias("option")).agg(F.count(F.lit(1)).alias("votes"))


def approval_quorum(ops: DataFrame, quorum: int, by: tuple[str, ...] = (*BY, "key")) -> DataFrame:
    """Proposals (key) that ``quorum`` different replicas made; they take effect with the operation that
    completed the quorum, by arrival."""
    first = ops.groupBy(*by, "replica_id").agg(F.min(F.struct("arrival", "global_clock", "ts")).alias("v"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("v.arrival", "v.global_clock"))
    return first.withColumn("n", place).filter(F.col("n") == quorum).select(*by, F.col("v.ts").alias("ts"), F.col("replica_id").alias("completed_by"))


def quorum_rounds(ops: DataFrame, quorum: int, proposal: tuple[str, ...]) -> DataFrame:
    """Proposals (their columns) that ``quorum`` different replicas made, each time anew: when a round is complete,
    its votes are forgotten. By arrival, so one proposal's votes are folded as one array; the row is the completing
    vote's, with its round."""
    at = [*BY, *proposal]
    votes = ops.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("arrival", "global_clock", "replica_id", "ts", "clock"))).alias("votes"))
    vote = votes.schema["votes"].dataType.elementType
    begin = F.struct(F.array().cast("array<string>").alias("who"), F.array().cast(T.ArrayType(vote)).alias("done"))

    def step(s: Column, v: Column) -> Column:
        who = F.array_union(s["who"], F.array(v["replica_id"]))
        full = F.size(who) >= quorum
        return F.struct(F.when(full, F.array().cast("array<string>")).otherwise(who).alias("who"), F.when(full, F.concat(s["done"], F.array(v))).otherwise(s["done"]).alias("done"))

    done = votes.select(*at, F.aggregate("votes", begin, step)["done"].alias("done"))
    return done.select(*at, F.posexplode("done").alias("round", "v")).select(*at, "round", "v.*")


def epoch_bound(ops: DataFrame, epoch: Column, clears: Column, inner: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Only operations of the newest epoch count; a clear opens an epoch without contributing."""
    rows = ops.withColumns({"epoch": epoch, "clears": clears})
    newest = rows.groupBy(*BY).agg(F.max("epoch").alias("newest"))
    live = rows.join(newest, list(BY)).filter((F.col("epoch") == F.col("newest")) & ~F.col("clears")).drop("newest", "epoch", "clears")
    return inner(live)


# graphs and trees


def grow_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unions; an edge doesn't need its ends."""
    return vertices.distinct(), edges.distinct()


def two_phase_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges are 2P sets of their own; losing a vertex leaves its edges."""
    return two_phase_set(vertices), two_phase_set(edges)


def replicated_tree(adds: DataFrame, removed: DataFrame, moves: DataFrame) -> DataFrame:
    """Present nodes (OR set of add tags) with the parent of their newest add or move (in str)."""
    present = or_set(adds, removed)
    parent = adds.filter(upserts()).select(*BY, "key", "str", "ts", "replica_id", "global_clock").unionByName(moves.select(*BY, "key", "str", "ts", "replica_id", "global_clock"))
    parent = parent.groupBy(*BY, "key").agg(F.max(F.struct("ts", "replica_id", "global_clock", "str"))["str"].alias("parent"))
    return present.join(parent, [*BY, "key"])


def tree_depths(nodes: DataFrame, *, node: str = "node", parent: str = "parent") -> DataFrame:
    """Depth of each node below a root (null parent), by doubling: each turn, a node's known ancestor gives its own
    ancestor, so a chain of n takes about log n joins. Nodes without a root above them are left out; a cycle raises."""
    up = F.col(parent)
    now = saved(nodes.select(F.col(node).alias("node"), up.alias("above"), F.when(up.isNull(), 0).otherwise(1).alias("depth")))
    most = now.count()
    for turn in count():
        todo = now.filter("above IS NOT NULL")
        if todo.isEmpty():
            return now.select("node", "depth")
        if 1 << turn > 2 * most:
            raise ValueError("the tree has a cycle")
        jump = now.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        moved = todo.join(jump, "above").select("node", F.col("next").alias("above"), (F.col("depth") + F.col("more")).cast("int").alias("depth"))
        now = saved(now.filter("above IS NULL").unionByName(moved))


# sequences


def positional_list(inserts: DataFrame, removed: DataFrame, position: str | list[str]) -> DataFrame:
    """Elements that weren't removed, in order of their position ids (fractions, digit paths or ordered keys)."""
    at = [position] if isinstance(position, str) else position
    live = inserts.join(removed.select(*BY, "tag").distinct(), [*BY, "tag"], "left_anti")
    return ranked(live, list(BY), [*map(F.col, at), F.col("tag")], "place")
