"""Ranks in two levels: one range shuffle puts rows in order, ranks are counted inside a partition's share of
a group, and the counts of the shares before it are added. No task holds a group, whatever its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.session import saved

#: Names that the rows must not have yet.
SHARE, NUMBER, BEFORE = "share_", "number_", "before_"


def in_shares(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Rows in order of ``by`` and ``order``, dealt to range partitions of about equal size, with their partition's
    number (SHARE; numbers rise in the same order). Written once, so that every later use sees the same partitions."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    at = [*(F.col(b) for b in by), *order]
    return saved(rows.repartitionByRange(*at).withColumn(SHARE, F.spark_partition_id()))


def _before(parts: DataFrame, by: list[str], amount: str) -> DataFrame:
    """For (by, SHARE) with an amount, the sum of the group's earlier shares: at most a row per partition and group."""
    w = Window.partitionBy(*by).orderBy(SHARE).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(BEFORE, F.coalesce(F.sum(amount).over(w), F.lit(0))).select(*by, SHARE, BEFORE)


def _joined(rows: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    right = parts.select(F.col(SHARE).alias("share_of_"), *(F.col(b).alias(f"by_{i}_") for i, b in enumerate(by)), BEFORE)
    on = F.col(SHARE) == F.col("share_of_")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"by_{i}_"))
    return rows.join(right, on).drop("share_of_", *(f"by_{i}_" for i in range(len(by))))


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order`` within their group of equal ``by`` (nulls are a group), from 1, as a
    long. Rows that ``order`` holds equal are numbered in any order, so it should name a key."""
    kept = in_shares(rows, by, order)
    inside = kept.withColumn(NUMBER, F.row_number().over(Window.partitionBy(SHARE, *by).orderBy(*order)))
    parts = _before(kept.groupBy(SHARE, *by).agg(F.count(F.lit(1)).alias("n_")), by, "n_")
    return _joined(inside, parts, by).withColumn(name, F.col(NUMBER) + F.col(BEFORE)).drop(SHARE, NUMBER, BEFORE)


def summed(rows: DataFrame, by: list[str], order: list[Column | str], amount: str, name: str = "upto") -> DataFrame:
    """``rows`` with the sum of ``amount`` over their group's rows up to and including them, in two levels."""
    kept = in_shares(rows, by, order)
    w = Window.partitionBy(SHARE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = kept.withColumn(NUMBER, F.sum(amount).over(w))
    parts = _before(kept.groupBy(SHARE, *by).agg(F.sum(amount).alias("n_")), by, "n_")
    return _joined(inside, parts, by).withColumn(name, F.col(NUMBER) + F.col(BEFORE)).drop(SHARE, NUMBER, BEFORE)


def neighboured(rows: DataFrame, by: list[str], order: list[Column | str], values: dict[str, str], step: int = -1) -> DataFrame:
    """``rows`` with values of the row before (``step`` -1) or after (1) them in their group: new name to column. A
    share's edge takes them from the nearest share that has rows of the group."""
    kept = in_shares(rows, by, order)
    w = Window.partitionBy(SHARE, *by).orderBy(*order)
    shift = F.lag if step < 0 else F.lead
    take = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    inside = kept.withColumns({"near_": shift(take).over(w), NUMBER: F.row_number().over(w)})
    edge = (F.max_by if step < 0 else F.min_by)(F.struct(take.alias("v")), F.col(NUMBER))
    edges = inside.groupBy(SHARE, *by).agg(edge.alias("e_"))
    across = edges.withColumn(BEFORE, shift("e_").over(Window.partitionBy(*by).orderBy(SHARE))).select(*by, SHARE, BEFORE)
    out = _joined(inside, across, by).withColumn("near_", F.coalesce("near_", F.col(BEFORE)["v"]))
    return out.withColumns({n: F.col("near_")[n] for n in values}).drop(SHARE, NUMBER, BEFORE, "near_")
