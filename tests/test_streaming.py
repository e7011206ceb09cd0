from pyspark.sql import functions as F

from confluo.sources import oplog
from confluo.streaming import apply as streams
from confluo.streaming import stateful


def test_batches_give_what_one_fold_gives(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(600).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 101).alias("ts"), F.col("id").alias("n"))
    merge = streams.newest_per_key(["k"], "ts", "n")
    version = -1
    for part in range(3):
        rows.filter(F.col("n") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        version = streams.apply_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/state", f"{folder}/checkpoint", merge)
    got = sorted(map(tuple, streams.state(spark, f"{folder}/state", version).collect()))
    assert version == 2 and got == sorted(map(tuple, merge(rows).collect()))


def test_bucketed_state_rewrites_what_a_batch_touches(spark, tmp_path):
    import os

    folder = str(tmp_path)
    rows = spark.range(600).select((F.col("id") % 70).alias("k"), (F.col("id") * 37 % 101).alias("ts"), F.col("id").alias("n"))
    merge, seen = streams.newest_per_key(["k"], "ts", "n"), None
    for number, part in enumerate((F.col("k") >= 0, F.col("k") == 3, F.col("k") < 5, F.col("k") < 5)):
        batch = rows.filter(part & (F.col("n") % 3 == number % 3))
        seen = batch if seen is None else seen.unionByName(batch)
        sink = streams.versioned_merge(folder, merge, ["k"])
        sink(batch, number)
        sink(batch, number)  # comes again
    assert len([x for x in os.listdir(f"{folder}/version=1") if x.startswith("bucket=")]) == 1
    got = sorted(map(tuple, streams.state(spark, folder, 3, buckets=True).select("k", "ts", "n").collect()))
    assert got == sorted(map(tuple, merge(seen).select("k", "ts", "n").collect()))


def test_a_batch_that_comes_again_has_no_second_effect(spark, tmp_path):
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    sink = streams.versioned_merge(str(tmp_path), total)
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    for number in (0, 1, 1):
        sink(batch, number)
    assert sorted(map(tuple, streams.state(spark, str(tmp_path), 1).collect())) == [("a", 2), ("b", 4)]


def test_journal(spark, tmp_path):
    ops = oplog.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    oplog.append(ops, str(tmp_path / "j"))
    oplog.append(ops.limit(100), str(tmp_path / "j"))
    journal = oplog.read_journal(spark, str(tmp_path / "j"))
    assert journal.count() == ops.count()
    plan = oplog.in_range(spark.read.parquet(str(tmp_path / "j")), "7", 5, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(replica_id" in plan and "PushedFilters: [IsNotNull(global_clock)" in plan


def test_cells_in_the_state_store_over_batches_a_restart_and_expiry(spark, tmp_path):
    import time

    folder = str(tmp_path)
    schema = "document_id string, path string, key string, ts long, replica_id string, global_clock long, op_type string, num decimal(18,2)"

    def deliver(*rows):
        spark.createDataFrame([("d", "$.m", k, ts, "r", g, "upsert", None) for k, ts, g in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return stateful.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder, ttl_ms=8_000)

    shown = lambda: {r["key"]: r["ts"] for r in stateful.cells(spark, folder).collect()}
    deliver(("a", 5, 1), ("b", 1, 2), ("a", 3, 3))
    assert shown() == {"a": 5, "b": 1}
    deliver(("a", 4, 4), ("b", 2, 5), ("b", 2, 5))  # an older one and a redelivery change nothing
    assert shown() == {"a": 5, "b": 2}
    assert spark.read.parquet(f"{folder}/changes").filter("key = 'a'").count() == 1
    time.sleep(9)
    deliver(("c", 1, 6))  # both others are out of time and their state is dropped
    deliver(("a", 1, 7))
    changes = spark.read.parquet(f"{folder}/changes").filter("key = 'a'").collect()
    assert sorted((r["ts"], r["changes"]) for r in changes) == [(1, 1), (5, 1)]
    assert spark.conf.get(stateful.STORE) != stateful.ROCKS  # the session's own setting is back
