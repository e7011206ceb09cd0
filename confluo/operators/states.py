"""State of every strategy as one table that merges: what is kept of a log per property, cell and part.

A cell is what a strategy decides about on its own: the whole register, a key, an element, a slot, a voter. A part is a
replica where strategies tell replicas apart, else nothing. Of each part the table keeps aggregates that combine in any
order: newest and oldest operations, extremes, sums, clocks. So the states of two logs, or of two replicas that saw
different operations, merge into the state of all of them, and ``shown`` reads any strategy's value off it. Fields with
different strategies share the table, so a model of any number of fields is one pass over its log.

Resets of first-writer-wins properties follow the order of arrival, which aggregates can't; they are a barrier of the
property's own. Operations before a log's last barrier are left out when its state is made, and a state's rows that
arrived before another state's barrier go when both are merged, which is right for logs that arrived one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions import keys, values
from confluo.operators import folds, sequences
from confluo.operators.folds import BY, amounts, clears, removes, upserts
from confluo.operators.joins import beside
from confluo.operators.ranks import ranked
from confluo.session import saved

REGISTERS = ("lww_register", "fww_register", "max_wins", "min_wins", "counter", "g_counter", "bounded_counter")
#: Strategies whose removes undo what the removing replica has seen.
OBSERVING = ("or_set", "or_map", "replicated_tree")
FIRST_WINS = ("fww_register", "fww_set", "fww_map")
LISTS = ("array_lcs", "lseq", "rga")
KEYED = ("g_set", "two_phase_set", "lww_set", "fww_set", "sorted_set", "priority_queue", "lww_map", "fww_map", "counter_map", "max_wins_map", "min_wins_map", "fixed_size_array")
GRAPHS = ("graph", "two_phase_graph")
STRATEGIES = (*REGISTERS, "average_register", *KEYED, *OBSERVING, *GRAPHS, *LISTS, "vote_counter", "state_machine")
KEYS = [*BY, "strategy", "cell", "part"]
BETWEEN = "\x1f"


def _is(*names: str) -> Column:
    return F.col("strategy").isin(*names)


def _cell() -> Column:
    """The cell of an operation; null for a reset of its whole property."""
    edge = F.concat_ws(BETWEEN, F.coalesce("kind", F.lit("")), F.coalesce("key", F.lit("")), F.coalesce("str", F.lit("")))
    element = F.when(upserts(), F.when(_is("rga"), keys.of_id(F.col("global_clock"), F.col("replica_id"))).otherwise(F.col("tag"))).otherwise(F.col("ref"))
    whole = F.when(_is(*FIRST_WINS) & clears(), F.lit(None)).when(_is(*REGISTERS, "average_register"), "")
    return whole.when(_is(*GRAPHS), edge).when(_is(*LISTS), element).when(_is("vote_counter"), F.coalesce("str", "replica_id")).when(_is("state_machine"), F.col("op_id")).otherwise(F.col("key"))


#: The table's aggregates, and how they combine.
COMBINE = {
    "newest": "max",
    "oldest": "min",
    "written": "max",
    "first_add": "min",
    "last_add": "max",
    "first_remove": "min",
    "last_remove": "max",
    "largest": "max",
    "smallest": "min",
    "up": "sum",
    "down": "sum",
    "failed": "sum",
    "add_clock": "max",
    "gone_clock": "max",
    "arrived": "min",
    "cleared": "max",
    "pos": "min",
    "ref": "min",
}


def _combined() -> list[Column]:
    return [getattr(F, how)(name).alias(name) for name, how in COMBINE.items()]


def _buffers() -> dict[str, Column]:
    """An operation's own part of each aggregate."""
    move = F.coalesce(F.col("kind") == "move", F.lit(False))
    add = upserts() & ~move
    carried = F.when(_is("vote_counter"), values.text(F.col("key"))).when(_is("replicated_tree", "state_machine"), values.text(F.col("str"))).otherwise(F.col("payload_"))
    at = F.struct("ts", "replica_id")
    whole = F.struct("ts", "replica_id", "global_clock", "op_type", carried.alias("value"))
    some = lambda test, x: F.when(test, x)
    number = F.col("num").cast("decimal(38,2)")
    grows = amounts() & F.coalesce(F.col("num") > 0, F.lit(False))
    return {
        "newest": whole,
        "oldest": whole,
        "written": some(upserts() | move, whole),
        "first_add": some(add, at),
        "last_add": some(add, at),
        "first_remove": some(removes() & ~move, at),
        "last_remove": some(removes() & ~move, at),
        "largest": some(add, carried),
        "smallest": some(add, carried),
        "up": some(grows, number),
        "down": some(amounts() & ~grows, -number),
        "failed": some(~grows, F.lit(1).cast("long")),
        "add_clock": some(add, F.col("clock")),
        "gone_clock": some(removes() & ~move, F.col("clock")),
        "arrived": F.col("arrival"),
        "cleared": F.lit(None).cast("long"),
        "pos": some(add, F.coalesce("pos", F.when(_is("array_lcs"), keys.of_number(F.col("num"))).otherwise(F.col("str")))),
        "ref": some(add & _is("rga"), F.col("ref")),
    }


def partial(ops: DataFrame, strategies: Iterable[str] = FIRST_WINS) -> DataFrame:
    """The state of a log whose rows have ``strategy``, the strategy of their property. ``strategies`` names all that occur,
    where that is known: without one whose resets are barriers, the log isn't searched for resets."""
    return _partial(ops, None, strategies)


def partial_of_each(ops: DataFrame, strategies: list[str]) -> DataFrame:
    """The state of a log that is taken for a property of each of the strategies. Strategies that cut the log into the
    same cells and parts keep the same of it, so the log is aggregated once for all of these."""
    alike: dict[tuple, list[str]] = {}
    for s in strategies:
        cut = "whole" if s in REGISTERS or s == "average_register" else "key" if s in KEYED or s in ("or_set", "or_map") else s
        alike.setdefault((cut, s in OBSERVING or s == "average_register", s in FIRST_WINS), []).append(s)
    likeness = {names[0]: names for names in alike.values()}
    rows = ops.withColumn("strategy", F.explode(F.array(*map(F.lit, likeness))))
    return _partial(rows, likeness, likeness)


def _partial(ops: DataFrame, likeness: dict[str, list[str]] | None, strategies: Iterable[str]) -> DataFrame:
    rows = ops.withColumns({"payload_": values.payload(ops), "cell": _cell()})
    first = _is(*FIRST_WINS)
    last = rows.filter(first & clears()).groupBy(*BY, "strategy").agg(F.max("arrival").alias("last_"))
    barriers = last.select(*BY, "strategy", "last_")
    cleared = not set(FIRST_WINS).isdisjoint(strategies) and not rows.filter(first & clears()).isEmpty()
    if cleared:
        rows = beside(rows, barriers, [*BY, "strategy"]).filter(F.col("last_").isNull() | (F.col("arrival") > F.col("last_"))).drop("last_")
    part = F.when(_is(*OBSERVING, "average_register"), F.col("replica_id")).otherwise("")
    kept = rows.filter(~(first & clears())).filter(F.col("cell").isNotNull() | ~first).withColumn("part", part)
    made = [getattr(F, COMBINE[name])(x).alias(name) for name, x in _buffers().items() if name != "cleared"]
    out = _without_barriers(kept.groupBy(*KEYS).agg(*made))
    if cleared:
        resets = barriers.select(*BY, "strategy", F.lit(None).cast("string").alias("cell"), F.lit("").alias("part"), F.col("last_").alias("cleared"))
        out = out.unionByName(resets, allowMissingColumns=True).select(out.columns)
    if likeness:
        names = F.create_map(*(x for s, all_ in likeness.items() for x in (F.lit(s), F.array(*map(F.lit, all_)))))
        out = out.withColumn("strategy", F.explode(names[F.col("strategy")])).select(out.columns)
    return out


def _without_barriers(state: DataFrame) -> DataFrame:
    """A state whose plan says that it has no barriers, so that looking for them runs nothing."""
    return state.withColumn("cleared", F.lit(None).cast("long")).select(*KEYS, *COMBINE)


def merged(*states: DataFrame) -> DataFrame:
    """The state of all that the given states have seen; first-writer-wins states in order of arrival."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    barriers = rows.filter("cleared IS NOT NULL").groupBy(*BY, "strategy").agg(F.max("cleared").alias("last_"))
    if barriers.isEmpty():
        return _without_barriers(rows.groupBy(*KEYS).agg(*(c for name, c in zip(COMBINE, _combined()) if name != "cleared")))
    out = rows.groupBy(*KEYS).agg(*_combined())
    # a row that one state began before the barrier holds nothing from after it
    fresh = rows.filter("cell IS NOT NULL OR cleared IS NULL")
    fresh = beside(fresh, barriers, [*BY, "strategy"]).filter("last_ IS NULL OR arrived > last_").drop("last_")
    again = fresh.groupBy(*KEYS).agg(*_combined())
    return again.unionByName(out.filter("cleared IS NOT NULL"))


def reset(state: DataFrame, properties: DataFrame) -> DataFrame:
    """State without what is kept of some properties (document_id, path): they begin anew."""
    gone = properties.select(*BY).distinct().withColumn("gone_", F.lit(True))
    return beside(state, gone, list(BY)).filter("gone_ IS NULL").drop("gone_")


def joined(state: DataFrame, parts: bool = True) -> DataFrame:
    """A row per cell: parts combined, with ``live`` for strategies that tell replicas apart, and ``average``. Without
    ``parts``, of strategies that don't tell replicas apart, a cell is a row of the state already."""
    rows = state.filter("cell IS NOT NULL OR cleared IS NULL")
    if not parts:
        return rows.select(*KEYS[:-1], *COMBINE, F.lit(None).cast("boolean").alias("live"), F.lit(None).cast("double").alias("average"))
    alive = F.col("add_clock").isNotNull() & (F.col("gone_clock").isNull() | (F.col("add_clock") > F.col("gone_clock")))
    mean = F.sum(F.when(F.col("written").isNotNull(), F.coalesce(F.col("written")["value"]["num"], F.lit(0)))).cast("double") / F.count("written")
    return rows.groupBy(*KEYS[:-1]).agg(*_combined(), F.bool_or(alive).alias("live"), mean.alias("average"))


def _live() -> Column:
    """Whether a cell shows."""
    last_add, last_remove = F.col("last_add"), F.col("last_remove")
    out = F.when(_is("two_phase_set", "two_phase_graph", *LISTS), last_add.isNotNull() & last_remove.isNull())
    out = out.when(_is("lww_set", "sorted_set", "priority_queue"), last_add.isNotNull() & (last_remove.isNull() | (last_add > last_remove)))
    out = out.when(_is("fww_set"), F.col("first_add").isNotNull() & (F.col("first_remove").isNull() | (F.col("first_add") <= F.col("first_remove"))))
    out = out.when(_is("lww_map"), F.col("newest")["op_type"] == "upsert").when(_is("fww_map"), F.col("oldest")["op_type"] == "upsert")
    out = out.when(_is(*OBSERVING), F.col("live")).when(_is("lww_register", "fww_register", "counter", "g_counter", "bounded_counter"), F.lit(True))
    out = out.when(_is("counter_map"), F.col("up").isNotNull() | F.col("down").isNotNull())
    return F.coalesce(out.otherwise(last_add.isNotNull()), F.lit(False))


def _value() -> Column:
    whole = values.number((F.coalesce("up", F.lit(0)) - F.coalesce("down", F.lit(0))).cast(values.NUMBER))
    unset = F.lit(None).cast(values.VALUE)
    kept = lambda c: F.when(F.col(c)["op_type"] == "upsert", F.col(c)["value"])
    out = F.when(_is("lww_register", "lww_map"), kept("newest")).when(_is("fww_register", "fww_map"), kept("oldest"))
    out = out.when(_is("max_wins", "max_wins_map"), F.col("largest")).when(_is("min_wins", "min_wins_map"), F.col("smallest"))
    out = out.when(_is("counter", "bounded_counter", "counter_map"), whole).when(_is("g_counter"), values.number(F.col("up").cast(values.NUMBER)))
    out = out.when(_is("average_register"), values.tagged(F.col("average"), T.DoubleType()))
    return out.when(_is("or_map", "replicated_tree", "sorted_set", "priority_queue", "vote_counter", "fixed_size_array", "state_machine", *LISTS), F.col("written")["value"]).otherwise(unset)


def shown(state: DataFrame) -> DataFrame:
    """document_id, path, strategy, key, value: what every field shows, a row per register, entry, element or option. Votes
    are counted per option; lists, queues and state machines are in no order yet (see ``ordered``)."""
    cells = joined(state)
    rows = cells.filter(_live()).select(*BY, "strategy", "cell", _value().alias("value"))
    votes = _is("vote_counter")
    key = F.when(_is(*REGISTERS, "average_register"), F.lit(None)).when(votes, F.col("value")["str"]).otherwise(F.col("cell"))
    # other rows are alone under their key
    keyed = rows.withColumn("key", key).groupBy(*BY, "strategy", "key").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    return keyed.select(*BY, "strategy", "key", F.when(votes, values.number(F.col("n"))).otherwise(F.col("value")).alias("value"))


def ordered(state: DataFrame, strategy: str, **params) -> DataFrame:
    """document_id, path, key, value, place of lists, sorted sets and queues, and the state of state machines."""
    cells = joined(state.filter(F.col("strategy") == strategy), strategy in (*OBSERVING, "average_register"))
    if strategy == "rga":
        list_ = F.concat_ws("\x00", *BY).alias("list_")
        known = saved(cells.filter("add_clock IS NOT NULL").select(*BY, list_, F.col("cell").alias("id"), F.col("ref").alias("left_id"), F.col("last_remove").isNotNull().alias("deleted"), F.col("written.value").alias("value")))
        walk = sequences.rga_order(known, by="list_")
        return walk.join(known.select("list_", "id", *BY, "value"), ["list_", "id"]).select(*BY, F.col("id").alias("key"), "value", F.col("place").cast("long").alias("place"), "deleted")
    if strategy == "state_machine":
        steps = [f"{a}>{b}" for a, b in params["transitions"]]
        moves = cells.filter("written IS NOT NULL").select(*BY, F.col("written.value.str").alias("str"), F.col("written.ts").alias("ts"), F.col("written.replica_id").alias("replica_id"), F.col("written.global_clock").alias("global_clock"), F.col("arrived").alias("arrival"))
        return folds.state_machine(moves, F.col("str"), lambda a, b: F.concat_ws(">", a, b).isin(steps), params["start"])
    live = cells.filter(_live()).select(*BY, F.col("cell").alias("key"), _value().alias("value"), "pos")
    order = {"sorted_set": [F.asc_nulls_first("value"), F.asc("key")], "priority_queue": [F.desc("value"), F.asc("key")]}.get(strategy, [F.asc("pos"), F.asc("key")])
    return ranked(live, list(BY), order, "place").select(*BY, "key", "value", "place", "pos")


def listed(state: DataFrame, strategies: tuple[str, ...] = LISTS) -> DataFrame:
    """document_id, path, strategy, key, value, place, pos of the elements that lists of any strategy show, in one ranking."""
    columns = [*BY, "strategy", "key", "value", "pos"]
    parts = []
    if set(strategies) - {"rga"}:
        cells = joined(state.filter(_is("array_lcs", "lseq")), parts=False).filter(_live())
        parts.append(cells.select(*BY, "strategy", F.col("cell").alias("key"), _value().alias("value"), "pos").select(columns))
    if "rga" in strategies:
        walk = ordered(state, "rga").filter("NOT deleted")
        parts.append(walk.withColumns({"strategy": F.lit("rga"), "pos": keys.of_long(F.col("place"))}).select(columns))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return ranked(rows, list(BY), ["pos", "key"], "place")


def compacted(state: DataFrame, threshold: int, minimum: DataFrame) -> DataFrame:
    """State without what no operation to come can need: dead cells whose add and remove are no newer than ``threshold``,
    and replicas' parts that the replica's own remove undid, if every replica has that remove by the global minimum (origin,
    version): the remove must be known everywhere, not just the add. What is shown stays as it is: of an OR map's live
    key the newest write stays, whichever replica's part it is in."""
    low = minimum.select(F.col("origin").alias("part"), F.col("version").alias("low_"))
    rows = beside(state, low, ["part"])
    undone = _is(*OBSERVING) & F.col("gone_clock").isNotNull() & (F.col("add_clock").isNull() | (F.col("add_clock") < F.col("gone_clock"))) & F.coalesce(F.col("gone_clock") <= F.col("low_"), F.lit(False))
    # by the keys that cells are joined by later, so that the state is dealt once
    newest = F.max(F.when(_is("or_map", "replicated_tree"), F.col("written"))).over(Window.partitionBy(*KEYS[:-1]))
    rows = rows.withColumn("top_", newest)
    needed = F.coalesce(F.col("written") == F.col("top_"), F.lit(False)) & _is("or_map", "replicated_tree")
    old = lambda c: F.coalesce(F.col(c)["ts"] <= threshold, F.lit(True))
    dead = _is("lww_set", "sorted_set", "priority_queue", "fww_set", "two_phase_set", "two_phase_graph", "lww_map", "fww_map") & ~_live_of_part()
    quiet = old("last_add") & old("last_remove") & old("first_add") & old("first_remove")
    drop = F.coalesce((undone & ~needed) | (dead & quiet), F.lit(False))
    return rows.filter(~drop).select(state.columns)


def _live_of_part() -> Column:
    """``_live`` of strategies that have one part per cell."""
    last_add, last_remove = F.col("last_add"), F.col("last_remove")
    out = F.when(_is("two_phase_set", "two_phase_graph"), last_add.isNotNull() & last_remove.isNull())
    out = out.when(_is("fww_set"), F.col("first_add").isNotNull() & (F.col("first_remove").isNull() | (F.col("first_add") <= F.col("first_remove"))))
    out = out.when(_is("lww_map"), F.col("newest")["op_type"] == "upsert").when(_is("fww_map"), F.col("oldest")["op_type"] == "upsert")
    return F.coalesce(out.otherwise(last_add.isNotNull() & (last_remove.isNull() | (last_add > last_remove))), F.lit(False))
