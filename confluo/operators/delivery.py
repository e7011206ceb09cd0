"""From delivered operations to applied ones: guards, orphans, routing, seeds, and partition files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.paths import parent
from confluo.operators import partitions
from confluo.session import saved

#: The timestamp of initial values, older than any operation.
SEED_TS = -(2**63)


def judged(ops: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``ops`` with the first rule each breaks, as ``reason``; null: applicable. A rule is a condition that
    must hold, and a null outcome breaks it."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return ops.withColumn("reason", reason)


def split_rejected(ops: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(applicable operations, rejected ones with their reason)."""
    rows = judged(ops, rules)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def orphans(ops: DataFrame, live_paths: DataFrame) -> DataFrame:
    """Operations below a path that isn't live (document_id, path): acknowledged but without effect."""
    rows = ops.withColumn("parent", parent(F.col("path")))
    live = live_paths.select("document_id", F.col("path").alias("parent")).distinct()
    return rows.filter(F.col("parent") != "$").join(live, ["document_id", "parent"], "left_anti").drop("parent")


def applied(ops: DataFrame, unapplied: DataFrame) -> DataFrame:
    """What goes to the journal: operations that weren't left unapplied."""
    return ops.join(unapplied.select("op_id").distinct(), "op_id", "left_anti").select(ops.columns)


def seeded(ops: DataFrame, values: DataFrame) -> DataFrame:
    """Initial values (document_id, path, key, num, str) as operations older than all others, so that any real
    one wins over them in a last-writer fold."""
    seeds = values.withColumns({"op_type": F.lit("upsert"), "ts": F.lit(SEED_TS), "replica_id": F.lit(""), "clock": F.lit(0).cast("long"), "global_clock": F.lit(0).cast("long"), "arrival": F.lit(-1).cast("long")})
    return ops.unionByName(seeds, allowMissingColumns=True)


def routed(ops: DataFrame, collections: list[str]) -> DataFrame:
    """Operations with ``target``: the collection that their first path segment names, or the header."""
    first = F.regexp_extract("path", r"^\$\.([A-Za-z_][A-Za-z0-9_]*)", 1)
    return ops.withColumn("target", F.when(first.isin(collections), first).otherwise("header"))


def save_partitions(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Write rows into their partitions; partitions without rows keep what they have. The last of ``by``, a number, is
    dealt PARTS_PER_FOLDER to a folder (``part_block``), which is written whole: other parts in it are carried over."""
    try:
        there = rows.sparkSession.read.schema(partitions.blocked(rows, by).schema).parquet(folder)
    except AnalysisException:  # nothing was saved yet
        there = None
    if there is not None:
        rows = saved(rows)
        parts = rows.select(*by).distinct()
        blocks = partitions.blocked(parts, by).select(*by[:-1], partitions.BLOCK).distinct()
        same = lambda a, b, names: reduce(and_, (a[n].eqNullSafe(b[n]) for n in names))
        near = there.join(F.broadcast(blocks), same(there, blocks, [*by[:-1], partitions.BLOCK]), "left_semi")
        rows = saved(rows.unionByName(near.join(parts, same(near, parts, by), "left_anti").select(rows.columns)))
    partitions.written(rows, folder, by)


def apply_to_partitions(state: DataFrame, ops: DataFrame, ranges: DataFrame, by: str, key: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New state of the parts that ``ops`` touch, and of no others: operations are routed by the catalog and
    merged with their part's rows (which carry ``part``)."""
    placed = partitions.route(ops, ranges, by, key)
    touched = placed.select(by, "part").distinct()
    return merge(state.join(touched, [by, "part"], "left_semi").unionByName(placed.select(state.columns)))


def catalog_changed(ranges: DataFrame, by: str, *, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The catalog after inserting, replacing and deleting ranges by (by, start_key)."""
    at = [by, "start_key"]
    gone = deletes.select(*at) if deletes is not None else None
    if upserts is not None:
        gone = upserts.select(*at) if gone is None else gone.unionByName(upserts.select(*at))
    out = ranges if gone is None else ranges.join(gone.distinct(), at, "left_anti").select(ranges.columns)
    return out if upserts is None else out.unionByName(upserts.select(ranges.columns))


@dataclass
class Pipeline:
    """Steps around an application of operations: ``before`` changes the operations, ``around`` takes the
    application over (and calls it or not), ``after`` sees the operations and the new state."""

    before: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    around: list[Callable[[Callable[[DataFrame], DataFrame], DataFrame], DataFrame]] = field(default_factory=list)
    after: list[Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=list)

    def run(self, ops: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
        for step in self.before:
            ops = step(ops)
        for step in reversed(self.around):
            apply = partial(step, apply)
        state = apply(ops)
        for step in self.after:
            state = step(ops, state)
        return state
