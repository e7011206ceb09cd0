"""Laws of the folds: the order of delivery and redelivery don't matter; ties and quirks are as stated."""

import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from confluo.operators import folds, joins
from confluo.sources import oplog

FIELDS = [f.name for f in oplog.SCHEMA]


def log(spark, rows):
    """rows: (op_type, key, num, ts, replica) in order of creation."""
    clocks: dict[str, int] = {}
    out = []
    for i, (kind, key, num, ts, replica) in enumerate(rows):
        clocks[replica] = clocks.get(replica, 0) + 1
        out.append(("d", "$.p", kind, key, None if num is None else Decimal(num), None, f"{replica}:{i}", ts, replica, clocks[replica], i, i, f"{replica}:{i}", None, None, None, None, None))
    return spark.createDataFrame(out, oplog.SCHEMA)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


CONVERGENT = ["lww_register", "max_wins", "min_wins", "average_register", "g_set", "two_phase_set", "lww_set", "fww_set", "lww_map", "fww_map", "max_wins_map", "min_wins_map", "sorted_set", "priority_queue"]
op = st.tuples(st.sampled_from(["upsert", "remove"]), st.sampled_from("abc"), st.integers(-5, 5), st.integers(0, 6), st.sampled_from("xyz"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(op, min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_permutation_and_duplication_change_nothing(spark, ops, rng):
    df = log(spark, ops)
    shuffled = df.collect()
    rng.shuffle(shuffled)
    other = spark.createDataFrame(shuffled + shuffled[: len(shuffled) // 2], oplog.SCHEMA)
    for name in CONVERGENT:
        fold = getattr(folds, name)
        assert rows(fold(df)) == rows(fold(other)), name


def test_registers(spark):
    df = log(spark, [("upsert", "a", 1, 5, "x"), ("upsert", "a", 2, 5, "y"), ("upsert", "a", 9, 1, "z")])
    assert folds.lww_register(df).first()["num"] == 2  # a tie goes to the larger replica
    assert folds.fww_register(df).first()["num"] == 9
    removed = log(spark, [("upsert", "a", 1, 5, "x"), ("remove", "a", None, 6, "x")])
    assert folds.lww_register(removed).first()["num"] is None
    assert folds.average_register(df).first()["average"] == pytest.approx(4)


def test_counters(spark):
    df = log(spark, [("upsert", "a", 7, 1, "x"), ("upsert", "a", -3, 2, "x"), ("upsert", "b", 0, 3, "y")])
    assert folds.counter(df).first()["num"] == 4
    grown = folds.g_counter(df).first()
    assert (grown["num"], grown["failed"]) == (7, 2)
    assert folds.bounded_counter(df, 5, 10).first()["shown"] == 5
    assert {r["key"]: r["num"] for r in folds.counter_map(df).collect()} == {"a": 4, "b": 0}


def test_set_ties(spark):
    tie = log(spark, [("upsert", "a", 1, 5, "x"), ("remove", "a", None, 5, "x")])
    assert folds.lww_set(tie).count() == 0  # remove wins
    assert folds.fww_set(tie).count() == 1  # add wins
    assert folds.two_phase_set(log(spark, [("remove", "a", None, 1, "x"), ("upsert", "a", 1, 9, "x")])).count() == 0


def test_observed_remove_keeps_concurrent_add(spark):
    df = log(spark, [("upsert", "a", 1, 1, "x"), ("upsert", "a", 1, 1, "y"), ("remove", "a", None, 2, "x")])
    assert folds.or_set(df, folds.observed_tags(df)).count() == 1
    alone = log(spark, [("upsert", "a", 1, 1, "x"), ("remove", "a", None, 2, "x")])
    assert folds.or_set(alone, folds.observed_tags(alone)).count() == 0
    again = log(spark, [("upsert", "a", 1, 1, "x"), ("remove", "a", None, 2, "x"), ("upsert", "a", 4, 3, "x")])
    assert folds.or_map(again, folds.observed_tags(again)).first()["num"] == 4


def test_quorum_and_epoch(spark):
    df = log(spark, [("upsert", "a", 1, 1, "x"), ("upsert", "a", 1, 2, "x"), ("upsert", "a", 1, 3, "y")])
    won = folds.approval_quorum(df, 2).first()
    assert (won["ts"], won["completed_by"]) == (3, "y")
    assert folds.approval_quorum(df, 3).count() == 0
    from pyspark.sql import functions as F

    counted = folds.epoch_bound(df, F.col("ts") % 2 + F.when(F.col("ts") == 3, 1).otherwise(0), F.lit(False), folds.counter)
    assert counted.first()["num"] == 1


def test_rga_orders_like_repeated_insertion(spark):
    rng = random.Random(4)
    nodes, text = [], []
    for i in range(1, 60):
        left = rng.choice([None, *[n[1] for n in nodes]])
        nodes.append(("d", i, left, False))
        text.insert(0 if left is None else text.index(left) + 1, i)
    got = folds.rga_order(spark.createDataFrame(nodes, "document_id string, id long, left_id long, deleted boolean"))
    assert [r["id"] for r in got.orderBy("place").collect()] == text


def test_empty_log(spark):
    empty = spark.createDataFrame([], oplog.SCHEMA)
    for name in CONVERGENT:
        assert getattr(folds, name)(empty).count() == 0


def test_quorum_passes_again_when_its_votes_are_forgotten(spark):
    votes = [("upsert", "p", 1, t, r) for t, r in enumerate("aabacbbac")]
    done = folds.quorum_rounds(log(spark, votes), 2, ("key",)).orderBy("round").collect()
    # a a b | a c | b b a | c
    assert [(r["round"], r["ts"], r["replica_id"]) for r in done] == [(0, 2, "b"), (1, 4, "c"), (2, 7, "a")]


def test_depths_by_doubling(spark):
    chain = [(i, i - 1 if i else None) for i in range(80)] + [(200, 199), (201, 200)]  # two whose root is missing
    got = {r["node"]: r["depth"] for r in folds.tree_depths(spark.createDataFrame(chain, "node long, parent long")).collect()}
    assert got == {i: i for i in range(80)}
    with pytest.raises(ValueError):
        folds.tree_depths(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"))


def test_every_strategy_has_a_fold(spark):
    from confluo.plans.registry import FOLDS, INTENTS, StrategySpec

    assert set(FOLDS) == set(INTENTS)
    given = {"fixed_size_array": {"size": 3}, "state_machine": {"transitions": [("a", "b")], "start": "a"}, "bounded_counter": {"low": 0, "high": 9}}
    ops = log(spark, [("upsert", "1", 2, 5, "x"), ("remove", "2", 1, 6, "y")])
    for name in FOLDS:
        StrategySpec(name, tuple(given.get(name, {}).items())).folded(ops).collect()


def test_only_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    n = F.col("id")
    rows = spark.range(2_000).select(n, F.when(n < 1_000, 7).when(n < 1_200, F.lit(None)).otherwise(n % 50 + 100).cast("long").alias("k"))
    small = spark.range(0, 140).select(F.nullif(n, F.lit(3)).alias("k"), (n * 2).alias("twice"))
    for name, value in (("adaptive.coalescePartitions.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        out = joins.beside(rows, small, ["k"], hot=lambda: joins.hot_keys(rows, ["k"])).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name in ("adaptive.coalescePartitions.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
    assert sorted(r["id"] for r in out) == list(range(2_000))
    assert all(r["twice"] == (6 if r["k"] is None else r["k"] * 2 if r["k"] < 140 else None) for r in out)
    tasks = {k: len({r["task"] for r in out if r["k"] == k}) for k in {r["k"] for r in out}}
    assert tasks[7] > 1 and tasks[None] > 1
    assert all(t == 1 for k, t in tasks.items() if k not in (7, None))
