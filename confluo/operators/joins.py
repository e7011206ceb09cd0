"""Joins whose build side is broadcast only below a counted bound."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.session import saved

#: Rows that are broadcast at most, the salts of a join beyond that, and rows of a key that make it hot.
BROADCAST_ROWS, SALTS, HOT_ROWS = 200_000, 32, 50_000


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than HOT_ROWS rows have, kept: one for every HOT_ROWS rows at most."""
    return saved(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > HOT_ROWS).select(*keys))


def beside(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left", size: int | None = None, hot: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``rows`` with the columns of ``small``, which has a row per ``keys`` at most; nulls of keys are equal. A table
    of more than BROADCAST_ROWS rows is joined by shuffle, each of its rows once per salt, so that a hot key is dealt
    to several tasks. ``size`` is the count of a table that is saved already, and ``hot`` gives the only keys that need
    salts, if they are cheap to tell; it is asked where the table is joined by shuffle."""
    if size is None:
        small = saved(small)
        size = small.count()
    rest = [c for c in small.columns if c not in keys]
    right = small.select(*(F.col(k).alias(f"key_{i}_") for i, k in enumerate(keys)), *rest)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"key_{i}_")) for i, k in enumerate(keys)))
    names = [f"key_{i}_" for i in range(len(keys))]
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), same, how).drop(*names)
    salts, deal = F.lit(SALTS - 1), F.pmod(F.xxhash64(*(c for c, t in rows.dtypes if not t.startswith("map"))), F.lit(SALTS)).cast("int")
    if hot is not None:
        known = F.broadcast(hot().select(*(F.col(k).alias(f"hot_{i}_") for i, k in enumerate(keys)), F.lit(True).alias("is_hot_")))
        marked = lambda side, of: side.join(known, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"hot_{i}_")) for i, k in enumerate(of))), "left").drop(*(f"hot_{i}_" for i in range(len(of))))
        rows, right = marked(rows, keys), marked(right, [f"key_{i}_" for i in range(len(keys))])
        salts, deal = F.when(F.col("is_hot_"), salts).otherwise(0), F.when(F.col("is_hot_"), deal).otherwise(0)
    salted = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), salts))).drop("is_hot_")
    dealt = rows.withColumn("dealt_", deal).drop("is_hot_")
    return dealt.join(salted, same & (F.col("dealt_") == F.col("salt_")), how).drop(*names, "salt_", "dealt_")
