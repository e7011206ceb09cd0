"""Which tombstones may go. A policy is a predicate over (timestamp, replica, version) columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions import values
from confluo.operators.folds import BY, observed_tags, removes, upserts
from confluo.session import saved


def by_age(threshold: int) -> Column:
    return F.col("ts") <= threshold


def by_version(ops: DataFrame, minimum: DataFrame) -> DataFrame:
    """``ops`` with ``safe``: every replica has the version, by the global minimum (origin, version)."""
    low = minimum.select(F.col("origin").alias("replica_id"), F.col("version").alias("low"))
    return ops.join(low, "replica_id", "left").withColumn("safe", F.coalesce(F.col("clock") <= F.col("low"), F.lit(False))).drop("low")


def compact_lww_set(ops: DataFrame, threshold: int) -> DataFrame:
    """Elements' newest add and remove, without those that are dead and safe on both counts."""
    state = ops.groupBy(*BY, "key").agg(F.max(F.when(upserts(), F.col("ts"))).alias("added"), F.max(F.when(removes(), F.col("ts"))).alias("gone"))
    dead = F.col("gone").isNotNull() & (F.col("added").isNull() | (F.col("gone") >= F.col("added")))
    safe = (F.col("gone") <= threshold) & (F.col("added").isNull() | (F.col("added") <= threshold))
    return state.filter(~F.coalesce(dead & safe, F.lit(False)))


def compact_two_phase_set(ops: DataFrame, threshold: int) -> DataFrame:
    """Elements with their oldest tombstone; a safe tombstone goes together with its add."""
    state = ops.groupBy(*BY, "key").agg(F.bool_or(upserts()).alias("added"), F.max(F.when(removes(), F.col("ts"))).alias("gone"))
    return state.filter(F.col("gone").isNull() | (F.col("gone") > threshold))


def compact_or_set(ops: DataFrame, removed: DataFrame, minimum: DataFrame) -> DataFrame:
    """Add tags with whether they are removed, without removed tags whose remove (remover, removed_clock; the newest, if
    several have seen the tag) every replica has. That the add is known everywhere isn't enough: where the remove isn't,
    the forgotten tag would come back."""
    tags = ops.filter(upserts()).select(*BY, "key", "tag")
    last = removed.groupBy(*BY, "key", "tag").agg(F.max(F.struct("removed_clock", "remover")).alias("by"))
    seen = by_version(last.select(*BY, "key", "tag", F.col("by.remover").alias("replica_id"), F.col("by.removed_clock").alias("clock")), minimum)
    marked = tags.join(seen.select(*BY, "key", "tag", "safe", F.lit(True).alias("removed")), [*BY, "key", "tag"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
    return marked.filter(~(F.col("removed") & F.coalesce("safe", F.lit(False)))).drop("safe")


def compact_lww_map(ops: DataFrame, threshold: int) -> DataFrame:
    """Newest operation per key, without safe ones of absent keys."""
    newest = ops.groupBy(*BY, "key").agg(F.max(F.struct("ts", "replica_id", "global_clock", "op_type")).alias("w")).select(*BY, "key", "w.ts", "w.op_type")
    return newest.filter(~(removes() & (F.col("ts") <= threshold)))


def compact_votes(votes: DataFrame, standing: DataFrame, threshold: int) -> DataFrame:
    """Voters' timestamps, without safe ones of voters who no longer have a vote."""
    newest = votes.groupBy(*BY, "replica_id").agg(F.max("ts").alias("ts"))
    keep = newest.join(standing.select(*BY, "replica_id").distinct().withColumn("votes", F.lit(True)), [*BY, "replica_id"], "left")
    return keep.filter(F.col("votes").isNotNull() | (F.col("ts") > threshold)).select(*BY, "replica_id", "ts")


def compact_fww_set(ops: DataFrame, threshold: int) -> DataFrame:
    """Elements' oldest add and remove, without those that are dead and safe on both counts."""
    state = ops.groupBy(*BY, "key").agg(F.min(F.when(upserts(), F.col("ts"))).alias("added"), F.min(F.when(removes(), F.col("ts"))).alias("gone"))
    dead = F.col("gone").isNotNull() & (F.col("added").isNull() | (F.col("gone") < F.col("added")))
    safe = (F.col("gone") <= threshold) & (F.col("added").isNull() | (F.col("added") <= threshold))
    return state.filter(~F.coalesce(dead & safe, F.lit(False)))


def compact_fww_map(ops: DataFrame, threshold: int) -> DataFrame:
    """Oldest operation per key, without safe ones of absent keys."""
    oldest = ops.groupBy(*BY, "key").agg(F.min(F.struct("ts", "replica_id", "global_clock", "op_type")).alias("w")).select(*BY, "key", "w.ts", "w.op_type")
    return oldest.filter(~(removes() & (F.col("ts") <= threshold)))


def compact_or_map(ops: DataFrame, removed: DataFrame, minimum: DataFrame) -> DataFrame:
    """Add tags as for an OR set, each with its key's newest write: that stays as long as a tag of the key does, whichever
    tag it came with, so the map shows what it showed."""
    newest = ops.filter(upserts()).groupBy(*BY, "key").agg(F.max(F.struct("ts", "replica_id", "global_clock", "num", values.payload(ops).alias("value"))).alias("w"))
    return compact_or_set(ops, removed, minimum).join(newest.select(*BY, "key", "w.num", "w.value"), [*BY, "key"])


#: Sorted sets and priority queues keep the same two timestamps per element as an LWW set.
compact_sorted_set = compact_priority_queue = compact_lww_set


def compact_two_phase_graph(ops: DataFrame, threshold: int) -> DataFrame:
    """Vertices and edges (kind) by themselves: a safe tombstone goes together with its add."""
    state = ops.groupBy(*BY, "kind", "key", "str").agg(F.bool_or(upserts()).alias("added"), F.max(F.when(removes(), F.col("ts"))).alias("gone"))
    return state.filter(F.col("gone").isNull() | (F.col("gone") > threshold))


def compact_tree(adds: DataFrame, removed: DataFrame, minimum: DataFrame) -> DataFrame:
    """Nodes' add tags without removed ones that every replica has; parent links stay, as moves may refer to them."""
    return compact_or_set(adds, removed, minimum)


#: What each strategy's compaction needs beside the log: a threshold in time. Strategies not named keep all they have.
BY_TIME: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "lww_set": compact_lww_set,
    "fww_set": compact_fww_set,
    "sorted_set": compact_lww_set,
    "priority_queue": compact_lww_set,
    "two_phase_set": compact_two_phase_set,
    "two_phase_graph": compact_two_phase_graph,
    "lww_map": compact_lww_map,
    "fww_map": compact_fww_map,
}


#: Strategies whose tombstones are removes that others must have seen.
BY_MINIMUM: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {"or_set": compact_or_set, "or_map": compact_or_map, "replicated_tree": compact_tree}


def compact_model(model, ops: DataFrame, threshold: int, minimum: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each property's compacted state by its strategy's rule, from the property's own operations; decorators keep what
    their inner strategy keeps. Removes that others must have seen stay without a global minimum."""
    out = {}
    specs = model.bound()
    for path, spec in specs.items():
        mine = model.operations(ops, path, list(specs))
        if spec.name in BY_TIME:
            mine = BY_TIME[spec.name](mine, threshold)
        elif spec.name in BY_MINIMUM and minimum is not None:
            mine = BY_MINIMUM[spec.name](mine.filter(~F.coalesce(F.col("kind") == "move", F.lit(False))), observed_tags(mine), minimum)
        elif spec.name == "fww_register":
            mine = compact_fww_register(mine, threshold)
        out[path] = mine
    return out


def compact_fww_register(ops: DataFrame, threshold: int) -> DataFrame:
    """First-write timestamps that aren't safe; once one is gone, a later write can win."""
    first = ops.filter(upserts()).groupBy(*BY).agg(F.min("ts").alias("ts"))
    return first.filter(F.col("ts") > threshold)


def compact_rga(nodes: DataFrame, *, by: str = "document_id") -> DataFrame:
    """Insert-after nodes (by, id, left_id, deleted, safe) without safe tombstones that nothing hangs on, parents
    following their children; one anti-join per level of a dead chain."""
    while True:
        left = nodes.select(by, F.col("left_id").alias("id")).filter("id IS NOT NULL").distinct().withColumn("used", F.lit(True))
        marked = nodes.join(left, [by, "id"], "left")
        gone = F.col("deleted") & F.col("safe") & F.col("used").isNull()
        if marked.filter(gone).isEmpty():
            return nodes
        nodes = saved(marked.filter(~gone).select(nodes.columns))
