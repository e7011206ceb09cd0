"""Cells of a document kept by Spark's own state store: the newest operation of each, with a time to live.

State is keyed by document, path and key, so a document of any size is spread over all tasks. A cell's state is
replaced when a newer operation arrives, and is dropped, by the next batch, when it has seen none for the time to live; an older operation
that arrives after that counts as the first. Every change is given out; what a cell shows is its newest change.
Batches, restarts and redelivery need nothing else: state and offsets are committed together.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["document_id", "path", "key"]
NEWEST = "ts long, replica_id string, global_clock long, op_type string, num string, changes long"
CHANGE = "document_id string, path string, key string, " + NEWEST
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """A query that starts within keeps its state in RocksDB and runs no batches without data, as with timeouts there would
    be no last one; the session's own settings are put back."""
    ours = {STORE: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def changes(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Every change of a cell's newest operation, by (ts, replica_id, global_clock), of a stream of operations."""
    columns = [c.split()[0] for c in CHANGE.split(", ")]

    def step(cell: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        best = now
        for batch in batches:
            for ts, replica, clock, kind, num in zip(batch["ts"], batch["replica_id"], batch["global_clock"], batch["op_type"], batch["num"]):
                if best is None or (ts, replica, clock) > tuple(best[:3]):
                    best = (int(ts), replica, int(clock), kind, None if pd.isna(num) else num, 0)
        if best is not now:
            best = (*best[:5], (now[5] if now else 0) + 1)
            state.update(best)
            yield pd.DataFrame([(*cell, *best)], columns=columns)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)

    rows = stream.select(*(F.coalesce(c, F.lit("")).alias(c) for c in CELL), "ts", "replica_id", "global_clock", "op_type", F.col("num").cast("string").alias("num"))
    timeout = "NoTimeout" if ttl_ms is None else "ProcessingTimeTimeout"
    return rows.groupBy(*CELL).applyInPandasWithState(step, CHANGE, NEWEST, "append", timeout)


def run(stream: DataFrame, folder: str, ttl_ms: int | None = None) -> list[int]:
    """Apply what is available; the rows of each batch. Changes go to ``folder``/changes, and a later run goes on."""
    with state_store(stream.sparkSession):
        query = changes(stream, ttl_ms).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """What each cell shows now: document_id, path, key, ts, replica_id, global_clock, op_type, num."""
    rows = spark.read.parquet(f"{folder}/changes")
    order = F.struct("ts", "replica_id", "global_clock", "op_type", "num")
    return rows.groupBy(*CELL).agg(F.max(order).alias("w")).select(*CELL, "w.*")
