"""Order keys, deterministic ids and version predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(*extra: str) -> Column:
    """The total order of operations: timestamp, then replica id by its bytes, then any tiebreak."""
    return F.struct("ts", "replica_id", *extra)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def operation_id(replica: str = "replica_id", clock: str = "global_clock") -> Column:
    """Deterministic in place of a random id: replays of one operation share it."""
    return F.concat_ws(":", F.col(replica), F.col(clock).cast("string"))


def in_version(version: Column, contiguous: Column, dots: Column) -> Column:
    """Whether a dotted version vector entry holds a version."""
    return (version <= F.coalesce(contiguous, F.lit(0))) | F.coalesce(F.array_contains(dots, version), F.lit(False))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe_by_time(ts: Column, threshold) -> Column:
    """Retention by age: no newer than the threshold."""
    return ts <= F.lit(threshold)
