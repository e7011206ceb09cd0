"""Incremental application of an operation stream.

State that merges (a semilattice per key) is kept in a Parquet table per epoch: each micro-batch is
folded, merged with the state of the buckets of keys it touches, and written as the next version. A batch that is
delivered again after a failure writes the same version, so effects happen once. Late operations
need no watermark: an older timestamp simply loses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.operators import sync


#: Hash buckets that keyed state is kept in.
BUCKETS = 64


def versioned_merge(path: str, merge: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: state version n + 1 is ``merge(state n and batch n)``. With ``keys``, state lies in
    hash buckets, and a batch rewrites only those it touches, as the next version of each. What a bucket's newest
    version is follows from the batches' folders, so a batch that is delivered again writes the same ones."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not keys:
            old = spark.read.parquet(f"{path}/v{number - 1}") if number > 0 else None
            rows = batch if old is None else old.unionByName(batch)
            merge(rows).write.mode("overwrite").parquet(f"{path}/v{number}")
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        rows = batch.withColumn("bucket", bucket).persist()
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        if number > 0:
            old = state(spark, path, number - 1, buckets=True).filter(F.col("bucket").isin(touched))
            news = old.select(rows.columns).unionByName(rows)
        else:
            news = rows
        merged = merge(news.drop("bucket")).withColumn("bucket", bucket)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        rows.unpersist()

    return sink


def newest_per_key(keys: list[str], *order: str) -> Callable[[DataFrame], DataFrame]:
    """Merge for last-writer-wins state: the row with the largest order key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys and c not in order]
        return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("w")).select(*keys, "w.*").select(rows.columns)

    return merge


def apply_stream(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> int:
    """Run the available data through the merge; the number of the last state version (-1: no data)."""
    query = stream.writeStream.foreachBatch(versioned_merge(path, merge, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p["batchId"] for p in query.recentProgress]
    return max(progress, default=-1)


def state(spark: SparkSession, path: str, version: int, buckets: bool = False) -> DataFrame:
    """State as of a version; of bucketed state, every bucket's newest folder up to it."""
    if not buckets:
        return spark.read.parquet(f"{path}/v{version}")
    rows = spark.read.parquet(path).filter(F.col("version") <= version)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"]).drop("version")


def distinct_operations(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Operations without redeliveries that arrive within ``delay``; the state is dropped after it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["replica_id", "global_clock"])


def catch_up(journal: DataFrame, required: DataFrame) -> DataFrame:
    """The part of a journal stream that a replica lacks, from a static table of requirements (origin,
    target_contiguous, source_contiguous, known, missing): ranges without the known dots, and the missing dots."""
    return sync.missing_operations(required, journal)


def newest_vectors(rows: DataFrame) -> DataFrame:
    """Merge for version vectors (replica_id, contiguous, dots): versions that arrive out of order wait as dots and
    join the prefix when the gap before them closes."""
    return sync.merged(rows, ["replica_id"]).select(rows.columns)


def version_dots(stream: DataFrame, version: str = "clock") -> DataFrame:
    """Each operation as a vector of its own, one dot."""
    return stream.select("replica_id", F.lit(0).cast("long").alias("contiguous"), F.array(F.col(version).cast("long")).alias("dots"))


def fan_out(stream: DataFrame, folder: str, checkpoint: str, receivers: dict[str, Column]) -> None:
    """One stream to several passive replicas: each receives, in a folder of its own, what its condition lets
    through. A batch that is delivered again overwrites what it wrote, so receivers see it once."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for name, wanted in receivers.items():
            rows.filter(wanted).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        rows.unpersist()

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
