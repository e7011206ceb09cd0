"""Which strategy merges which field: specs, defaults by type, a fluent model, and checks against a schema."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions import values
from confluo.functions.ordering import operation_id
from confluo.functions.paths import SEGMENT, segments, within
from confluo.operators import folds, states
from confluo.sources import oplog

#: Intents that each strategy accepts.
INTENTS = {
    "lww_register": {"set"},
    "fww_register": {"set", "clear"},
    "counter": {"increment", "set"},
    "g_counter": {"increment"},
    "bounded_counter": {"increment"},
    "max_wins": {"set"},
    "min_wins": {"set"},
    "average_register": {"set"},
    "state_machine": {"set"},
    "fixed_size_array": {"set_index"},
    "g_set": {"add"},
    "two_phase_set": {"add", "remove_value"},
    "lww_set": {"add", "remove_value"},
    "fww_set": {"add", "remove_value", "clear"},
    "or_set": {"add", "remove_value", "remove"},
    "sorted_set": {"add", "remove_value"},
    "priority_queue": {"add", "remove_value"},
    "array_lcs": {"add", "insert", "remove"},
    "lseq": {"add", "insert", "remove"},
    "rga": {"add", "insert", "remove"},
    "vote_counter": {"vote"},
    "lww_map": {"map_set", "map_remove"},
    "fww_map": {"map_set", "map_remove", "clear"},
    "or_map": {"map_set", "map_remove"},
    "counter_map": {"map_increment"},
    "max_wins_map": {"map_set"},
    "min_wins_map": {"map_set"},
    "graph": {"add_vertex", "add_edge"},
    "two_phase_graph": {"add_vertex", "remove_vertex", "add_edge", "remove_edge"},
    "replicated_tree": {"add_node", "remove_node", "move_node"},
}
DECORATOR_INTENTS = {"epoch_bound": {"epoch_clear"}, "approval_quorum": set()}
NUMERIC = {"counter", "g_counter", "bounded_counter", "average_register"}
COLLECTIONS = {"fixed_size_array", "g_set", "two_phase_set", "lww_set", "fww_set", "or_set", "sorted_set", "priority_queue", "array_lcs", "lseq", "rga"}
MAPS = {"lww_map", "fww_map", "or_map", "counter_map", "max_wins_map", "min_wins_map", "vote_counter"}
PARTITIONABLE = {"g_set", "two_phase_set", "lww_set", "fww_set", "or_set", "sorted_set", "lww_map", "fww_map", "or_map", "counter_map", "max_wins_map", "min_wins_map", "vote_counter", "array_lcs", "lseq", "rga"}


def _fixed_size_array(ops: DataFrame, size: int) -> DataFrame:
    return folds.fixed_size_array(ops.filter(folds.upserts()), size, F.col("key").cast("int"))


def _state_machine(ops: DataFrame, transitions: list[tuple[str, str]], start: str) -> DataFrame:
    steps = [f"{a}>{b}" for a, b in transitions]
    return folds.state_machine(ops.filter(folds.upserts()), F.col("str"), lambda a, b: F.concat_ws(">", a, b).isin(steps), start)


def _listed(strategy: str) -> Callable[[DataFrame], DataFrame]:
    """Lists: an element is named by its operation, or, if it is inserted after another, by clock and replica; removes
    name it in ``ref``."""

    def fold(ops: DataFrame) -> DataFrame:
        return states.ordered(states.partial(ops.withColumn("strategy", F.lit(strategy))), strategy)

    return fold


def _graph(ops: DataFrame) -> DataFrame:
    return ops.filter(folds.upserts()).select(*folds.BY, "kind", "key", "str").distinct()


def _two_phase_graph(ops: DataFrame) -> DataFrame:
    state = ops.groupBy(*folds.BY, "kind", "key", "str").agg(F.bool_or(folds.upserts()).alias("added"), F.bool_or(folds.removes()).alias("gone"))
    return state.filter("added AND NOT gone").drop("added", "gone")


def _tree(ops: DataFrame) -> DataFrame:
    moves = F.coalesce(F.col("kind") == "move", F.lit(False))
    adds = ops.filter(~moves)
    return folds.replicated_tree(adds, folds.observed_tags(adds), ops.filter(moves))


def _votes(ops: DataFrame) -> DataFrame:
    """The voter is named by ``str`` or else is the replica."""
    return folds.vote_counter(ops.withColumn("replica_id", F.coalesce("str", "replica_id")))


#: Every strategy as a fold of the log; some take parameters of the spec.
FOLDS: dict[str, Callable[..., DataFrame]] = {n: getattr(folds, n) for n in ("lww_register", "fww_register", "max_wins", "min_wins", "average_register", "counter", "g_counter", "bounded_counter", "counter_map", "lww_map", "fww_map", "max_wins_map", "min_wins_map", "g_set", "two_phase_set", "lww_set", "fww_set", "sorted_set", "priority_queue")} | {
    "or_set": lambda ops: folds.or_set(ops, folds.observed_tags(ops)),
    "or_map": lambda ops: folds.or_map(ops, folds.observed_tags(ops)),
    "vote_counter": _votes,
    "fixed_size_array": _fixed_size_array,
    "state_machine": _state_machine,
    "array_lcs": _listed("array_lcs"),
    "lseq": _listed("lseq"),
    "rga": _listed("rga"),
    "graph": _graph,
    "two_phase_graph": _two_phase_graph,
    "replicated_tree": _tree,
}
#: What makes two operations the same proposal.
PROPOSAL = ("op_type", "key", "num", "str", "kind", "epoch", "value", "pos", "ref")


def _approved(ops: DataFrame, quorum: int = 2) -> DataFrame:
    """The operations that take effect: a proposal's, with the vote that completed its quorum."""
    done = folds.quorum_rounds(ops, quorum, PROPOSAL).drop("round")
    return oplog.fitted(done.withColumns({"tag": operation_id(), "op_id": operation_id()}))


def _current_epoch(ops: DataFrame) -> DataFrame:
    """Operations of the newest epoch, without those that only open one (kind ``clear``)."""
    rows = ops.withColumn("epoch", F.coalesce("epoch", F.lit(0).cast("long")))
    newest = rows.groupBy(*folds.BY).agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, [*folds.BY, "epoch"]).filter(~F.coalesce(F.col("kind") == "clear", F.lit(False))).select(ops.columns)


#: Decorators unwrap operations: from a log to the log that the next one, or the fold, sees.
DECORATED: dict[str, Callable[..., DataFrame]] = {"approval_quorum": _approved, "epoch_bound": _current_epoch}


@dataclass(frozen=True)
class StrategySpec:
    """A field's merge behaviour: a strategy, its parameters and its decorators, outermost first. ``comparer``
    gives the identity of elements and keys, where it isn't theirs byte for byte."""

    name: str
    params: tuple[tuple[str, object], ...] = ()
    decorators: tuple[str, ...] = ()
    fold: Callable[[DataFrame], DataFrame] | None = None
    decorator_params: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()
    comparer: Callable[[Column], Column] | None = None

    def intents(self) -> set[str]:
        return set(INTENTS.get(self.name, set())).union(*(DECORATOR_INTENTS.get(d, set()) for d in self.decorators))

    def folded(self, ops: DataFrame) -> DataFrame:
        fold = self.fold or FOLDS.get(self.name)
        if fold is None:
            raise KeyError(f"no fold for {self.name}")
        if self.comparer is not None:
            ops = ops.withColumn("key", self.comparer(F.col("key")))
        return fold(self.unwrapped(ops), **dict(self.params))

    def unwrapped(self, ops: DataFrame) -> DataFrame:
        """The operations that take effect, through the decorators from the outermost in."""
        given = dict(self.decorator_params)
        for d in self.decorators:
            ops = DECORATED[d](ops, **dict(given.get(d, ())))
        return ops


@dataclass
class Model:
    """Strategies by path; anything not named follows its type."""

    schema: T.StructType
    specs: dict[str, StrategySpec] = field(default_factory=dict)

    def property(self, path: str, strategy: str, fold: Callable | None = None, comparer: Callable[[Column], Column] | None = None, **params) -> Model:
        old = self.specs.get(path, StrategySpec(strategy))
        self.specs[path] = StrategySpec(strategy, tuple(params.items()), old.decorators, fold, old.decorator_params, comparer)
        return self

    def decorate(self, path: str, decorator: str, **params) -> Model:
        """Decorators of one field apply in order of their names, the first outermost."""
        if decorator not in DECORATOR_INTENTS:
            raise ValueError(f"unknown decorator {decorator}")
        old = self.resolve(path)
        given = dict(old.decorator_params) | {decorator: tuple(params.items())}
        self.specs[path] = replace(old, decorators=tuple(sorted({*old.decorators, decorator})), decorator_params=tuple(sorted(given.items())))
        return self

    def field_type(self, path: str) -> T.DataType | None:
        """Type at a dotted path, names matched without regard to case."""
        now: T.DataType = self.schema
        for part in path.removeprefix("$").strip(".").split("."):
            found = next((f for f in now.fields if f.name.lower() == part.lower()), None) if isinstance(now, T.StructType) else None
            if found is None:
                return None
            now = found.dataType
        return now

    def resolve(self, path: str) -> StrategySpec:
        """The named strategy, else one by type; for paths that don't resolve, by their look."""
        if path in self.specs:
            return self.specs[path]
        kind = self.field_type(path)
        if kind is None:
            return StrategySpec("array_lcs" if "[" in path else "lww_register")
        return StrategySpec("lww_map" if isinstance(kind, T.MapType) else "array_lcs" if isinstance(kind, T.ArrayType) else "lww_register")

    def validate(self) -> list[str]:
        """Complaints about specs that don't fit the schema; empty if all do."""
        out = []
        for path, spec in self.specs.items():
            kind = self.field_type(path)
            if kind is None:
                out.append(f"{path}: not in the schema")
            elif spec.name in NUMERIC and not isinstance(kind, T.NumericType):
                out.append(f"{path}: {spec.name} needs a number, not {kind.simpleString()}")
            elif spec.name in COLLECTIONS and not isinstance(kind, T.ArrayType):
                out.append(f"{path}: {spec.name} needs an array, not {kind.simpleString()}")
            elif spec.name in MAPS and not isinstance(kind, T.MapType):
                out.append(f"{path}: {spec.name} needs a map, not {kind.simpleString()}")
            elif spec.name not in INTENTS and spec.fold is None:
                out.append(f"{path}: {spec.name} is unknown")
        return out

    def bound(self) -> dict[str, StrategySpec]:
        """The specs of all properties: named ones, and every other leaf of the schema by its type. A struct that no
        spec names isn't a property; its fields are, at any depth."""
        out = dict(self.specs)
        named = {p.lower() for p in out}

        def walk(struct: T.StructType, above: str) -> None:
            for f in struct.fields:
                path = f"{above}.{f.name}"
                if path.lower() in named:
                    continue
                if isinstance(f.dataType, T.StructType):
                    walk(f.dataType, path)
                elif not any(p.startswith((path.lower() + ".", path.lower() + "[")) for p in named):
                    out[path] = self.resolve(path)

        walk(self.schema, "$")
        return out

    def operations(self, ops: DataFrame, path: str, all_paths: list[str]) -> DataFrame:
        """The operations of one property: at its path, or below it and below no other property's. The last
        segment of a path below is the key where the operation has none."""
        mine = within(F.col("path"), path)
        for other in all_paths:
            if other != path and other.startswith(path):
                mine = mine & ~within(F.col("path"), other)
        below = F.when(F.col("path") != path, F.element_at(segments(F.col("path")), -1))
        return ops.filter(mine).withColumns({"key": F.coalesce("key", below), "path": F.lit(path)})

    def dispatched(self, ops: DataFrame) -> DataFrame:
        """Operations with the property they belong to as ``path`` and its strategy, the longest property that their
        path is or is below; others are left out. The table of properties is a literal of the plan, so this is a
        projection of one scan."""
        specs = self.bound()
        table = F.create_map(*(F.lit(x) for p, spec in specs.items() for x in (p, spec.name)))
        # most paths are a property's own, and need not be taken apart
        own = F.col("path").isin([p for p in specs if "$" + "".join(m.group() for m in re.finditer(SEGMENT, p)) == p])
        plain = F.split_part("path", F.lit("|"), F.lit(1))
        marks = F.when(~own, F.regexp_extract_all(plain, F.lit(SEGMENT), F.lit(0)))
        above = lambda n: F.concat(F.lit("$"), F.array_join(F.slice("marks_", F.lit(1), n), ""))
        lengths = F.filter(F.sequence(F.size("marks_"), F.lit(0)), lambda n: F.map_contains_key(table, above(n)))
        rows = ops.withColumn("marks_", marks).withColumn("depth_", F.when(~own, F.get(lengths, 0))).filter(own | F.col("depth_").isNotNull())
        below = F.when(F.col("depth_") < F.size("marks_"), F.element_at(segments(F.col("path")), -1))
        key = F.coalesce("key", below)
        root = F.when(own, F.col("path")).otherwise(above(F.col("depth_")))
        for p, spec in specs.items():
            if spec.comparer is not None:
                key = F.when(root == p, spec.comparer(key)).otherwise(key)
        return rows.withColumn("root_", root).withColumns({"key": key, "path": F.col("root_"), "strategy": F.try_element_at(table, F.col("root_"))}).drop("marks_", "depth_", "root_")

    def state(self, ops: DataFrame) -> DataFrame:
        """The state of all properties in one pass over the log. Decorated properties are unwrapped first, each from the
        log of its own."""
        specs = self.bound()
        if unknown := [p for p, spec in specs.items() if spec.fold is not None or spec.name not in states.STRATEGIES]:
            raise ValueError(f"no common state for {', '.join(unknown)}")
        rows = self.dispatched(ops)
        wrapped = {p: spec for p, spec in specs.items() if spec.decorators}
        if wrapped:
            columns = rows.columns
            out = rows.filter(~F.col("path").isin(list(wrapped)))
            for p, spec in wrapped.items():
                mine = spec.unwrapped(rows.filter(F.col("path") == p).drop("strategy"))
                out = out.unionByName(mine.withColumn("strategy", F.lit(spec.name)).select(columns))
            rows = out
        return states.partial(rows, [spec.name for spec in specs.values()])

    def table(self, ops: DataFrame) -> DataFrame:
        """document_id, path, strategy, key, value: what all properties show, from one pass over the log. A value is tagged
        (see ``functions.values``); bounded counters are clamped, and slots beyond an array's size don't show."""
        rows = states.shown(self.state(ops))
        value, seen = F.col("value"), F.lit(True)
        for p, spec in self.bound().items():
            params = dict(spec.params)
            if spec.name == "bounded_counter":
                value = F.when(F.col("path") == p, values.number(F.greatest(F.lit(params["low"]), F.least(F.lit(params["high"]), F.col("value.num"))).cast(values.NUMBER))).otherwise(value)
            if spec.name == "fixed_size_array":
                seen = seen & ((F.col("path") != p) | (F.col("key").try_cast("int") < params["size"]))
        return rows.filter(seen).withColumn("value", value)

    def apply(self, ops: DataFrame) -> dict[str, DataFrame]:
        """The state of every property, each folded from its own operations."""
        specs = self.bound()
        return {path: spec.folded(self.operations(ops, path, list(specs))) for path, spec in specs.items()}
