"""Explicit intents as operation rows. An intent that a field's strategy doesn't accept is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions import keys, values
from confluo.functions.ordering import operation_id
from confluo.operators import sequences, states
from confluo.operators.folds import BY
from confluo.operators.joins import beside, hot_keys
from confluo.plans.registry import StrategySpec
from confluo.session import saved
from confluo.sources import oplog

#: How each intent is recorded, as (operation type, payload fields taken from the intent).
RECORDED = {
    "set": ("upsert", {"value": "value"}),
    "clear": ("remove", {}),
    "increment": ("increment", {"value": "num"}),
    "add": ("upsert", {"value": "key"}),
    "insert": ("upsert", {"index": "index", "value": "value"}),
    "remove": ("remove", {"index": "index"}),
    "remove_value": ("remove", {"value": "key"}),
    "set_index": ("upsert", {"index": "index", "value": "value"}),
    "map_set": ("upsert", {"key": "key", "value": "value"}),
    "map_remove": ("remove", {"key": "key"}),
    "map_increment": ("increment", {"key": "key", "value": "num"}),
    "vote": ("upsert", {"voter": "voter", "option": "key"}),
    "add_vertex": ("upsert", {"vertex": "key"}),
    "remove_vertex": ("remove", {"vertex": "key"}),
    "add_edge": ("upsert", {"source": "source", "target": "target", "value": "value"}),
    "remove_edge": ("remove", {"source": "source", "target": "target"}),
    "add_node": ("upsert", {"node": "key", "parent": "parent", "value": "value"}),
    "remove_node": ("remove", {"node": "key"}),
    "move_node": ("upsert", {"node": "key", "parent": "parent"}),
    "epoch_clear": ("remove", {"epoch": "epoch"}),
}
PAYLOAD = ("key", "value", "num", "index", "voter", "source", "target", "parent", "epoch")
COLUMNS = "document_id string, path string, intent string, op_type string, " + ", ".join(f"{p} string" for p in PAYLOAD)


def record(document_id: str, path: str, spec: StrategySpec, intent: str, **given) -> dict:
    """One operation, without timestamp and clocks."""
    if intent not in spec.intents():
        raise NotImplementedError(f"{spec.name} doesn't take the intent {intent}")
    kind, fields = RECORDED[intent]
    if unknown := set(given) - set(fields):
        raise TypeError(f"{intent} has no {', '.join(sorted(unknown))}")
    payload = {to: None if given.get(name) is None else str(given[name]) for name, to in fields.items()}
    return {"document_id": document_id, "path": path, "intent": intent, "op_type": kind} | {p: payload.get(p) for p in PAYLOAD}


def operations(spark: SparkSession, rows: list[dict], replica_id: str, now: int, clock: int = 0, global_clock: int = 0) -> DataFrame:
    """Recorded intents of one replica with consecutive clocks and strictly rising timestamps."""
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) + (i,) for i, r in enumerate(rows)], COLUMNS + ", n long")
    return df.select(*(c.split()[0] for c in COLUMNS.split(", ")), F.lit(replica_id).alias("replica_id"), (F.lit(now) + F.col("n")).alias("ts"), (F.lit(clock + 1) + F.row_number().over(Window.partitionBy("document_id").orderBy("n")) - 1).cast("long").alias("clock"), (F.lit(global_clock + 1) + F.col("n")).alias("global_clock"))


#: What the payload of some intents is of.
KINDS = {"add_vertex": "vertex", "remove_vertex": "vertex", "add_edge": "edge", "remove_edge": "edge", "move_node": "move", "epoch_clear": "clear", "clear": "clear"}


def logged(rows: DataFrame) -> DataFrame:
    """Intents as rows of an operation log, which folds read: document_id, path, intent, replica_id, ts, clock and
    global_clock, with any of PAYLOAD; ``value`` of any type, tagged or not. A table of any size; nothing goes through the
    driver. A set to null is a remove. Intents by index need the list: see ``edited``."""
    given = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    named = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("intent"))
    type_ = named({intent: "upsert" if op_type == "increment" else op_type for intent, (op_type, _) in RECORDED.items()})
    kind = named(KINDS)
    value = values.tagged(F.col("value"), rows.schema["value"].dataType) if "value" in rows.columns else F.lit(None).cast(values.VALUE)
    text = values.read(value, T.StringType())
    number = F.coalesce(given("num"), text).try_cast("decimal(18,2)")
    out = rows.withColumns(
        {
            "op_type": F.when((F.col("intent") == "set") & value.isNull() & given("num").isNull(), "remove").otherwise(type_),
            "kind": kind,
            "num": number,
            "str": F.coalesce(given("voter"), given("target"), given("parent"), F.when(value["kind"] == "s", text)),
            "value": value,
            "key": F.coalesce(given("key"), given("source"), F.when(F.col("intent") == "set_index", given("index"))),
            "epoch": given("epoch").try_cast("long"),
            "arrival": F.col("arrival") if "arrival" in rows.columns else F.col("global_clock"),
            "tag": operation_id(),
            "op_id": operation_id(),
        }
    )
    return oplog.fitted(out)


def edited(edits: DataFrame, log: DataFrame, strategy: str | dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(operations, rejected edits) of intents by index on lists: document_id, path, intent (add, insert, remove), index,
    value, replica_id, ts, clock, global_clock and, optionally, arrival. ``strategy`` is that of all lists, or each path's;
    lists of several strategies go through together. An index refers to the list that ``log`` folds to, changed by the
    replica's own edits before in order of its clock; what is at it is looked up among the folded list's places. An index
    outside the list is rejected and changes nothing."""
    by_path = strategy if isinstance(strategy, dict) else {}
    used = tuple(sorted(set(by_path.values()) or {strategy}))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in by_path.items() for x in pair)), F.col("path")) if by_path else F.lit(strategy)
    rows = edits.withColumn("strategy", named)
    after = F.col("strategy") == "rga"
    rows = rows.withColumns({"tag": F.when(after, keys.of_id(F.col("global_clock"), F.col("replica_id"))).otherwise(operation_id()), "index": F.col("index").cast("long")})
    seen = states.listed(states.partial(log.withColumn("strategy", named), used), used)
    elements = saved(seen.select(*BY, "place", F.col("key").alias("id"), "pos"))
    sized = beside(rows, elements.groupBy(*BY).agg(F.count(F.lit(1)).alias("length")), list(BY), hot=lambda: hot_keys(rows, list(BY)))
    found = saved(sequences.located(sized.select(*sequences.EDITOR, "clock", "tag", "intent", "index", F.coalesce("length", F.lit(0)).alias("length"))))
    at = [*sequences.EDITOR, "clock", "tag"]
    placed = sequences.elements_at(found.filter("problem IS NULL"), elements, ["left", "right", "target"])
    placed = saved(placed.withColumns({"strategy": named, "inserts": F.col("target_place").isNull() & F.col("target_tag").isNull()}))
    known = placed.select(*at, F.coalesce("left_tag", "left_id").alias("left_ref"), F.coalesce("target_tag", "target_id").alias("target_ref"))
    if used != ("rga",):
        known = known.join(sequences.positioned(placed), at)
    both = rows.join(known, at)
    removes = F.col("intent") == "remove"
    value = values.tagged(F.col("value"), rows.schema["value"].dataType) if "value" in rows.columns else F.lit(None).cast(values.VALUE)
    made = both.withColumns(
        {
            "op_type": F.when(removes, "remove").otherwise("upsert"),
            "ref": F.when(removes, F.col("target_ref")).when(after, F.col("left_ref")),
            "value": F.when(~removes, value),
            "arrival": F.col("arrival") if "arrival" in rows.columns else F.col("global_clock"),
            "tag": operation_id(),
            "op_id": operation_id(),
        }
    )
    rejected = rows.join(found.filter("problem IS NOT NULL").select(*at, "problem"), at).drop("tag", "strategy")
    return oplog.fitted(made), rejected
