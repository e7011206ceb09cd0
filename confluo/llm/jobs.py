"""How the operators keep intermediate results: written once to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.session import saved
from confluo.session import shared_folder as checkpoint_dir

__all__ = ["checkpoint_dir", "if_small", "saved", "shuffle_partitions"]

#: Rows of a single id that are broadcast at most, some 20 MB.
BROADCAST_IDS = 1_000_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def if_small(ids: DataFrame) -> DataFrame:
    """A saved table of ids with a broadcast hint if its counted size allows; otherwise it is joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
