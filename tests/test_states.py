"""States that merge, values of any type, nested models, resets and compaction: each probe that was wrong once, as a test."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions import values
from confluo.operators import folds, ranks, retention, states
from confluo.plans import intents, queries
from confluo.plans.registry import INTENTS, Model
from confluo.sources import oplog

GIVEN = "document_id string, path string, intent string, key string, value string, num string, replica_id string, ts long, clock long, global_clock long"


def log(spark, rows, schema=GIVEN):
    """Intents: (path, intent, given), one after the other, of replica x or the one given."""
    out, clocks = [], {}
    for i, (path, intent, given) in enumerate(rows, 1):
        replica = given.get("replica", "x")
        clocks[replica] = clocks.get(replica, 0) + 1
        out.append(("d", path, intent, given.get("key"), given.get("value"), given.get("num"), replica, given.get("ts", i), clocks[replica], i))
    return intents.logged(spark.createDataFrame(out, schema))


def field(name, kind):
    return T.StructField(name, kind)


def shown(table):
    return {(r.path, r.key): (None if r.value is None else r.value["str"] if r.value["kind"] != "n" else float(r.value["num"])) for r in table.collect()}


NUMBER = T.DecimalType(18, 2)


def test_a_register_holds_text(spark):
    model = Model(T.StructType([field("title", T.StringType())]))
    ops = log(spark, [("$.title", "set", {"value": "hello"})])
    assert shown(model.table(ops)) == {("$.title", None): "hello"}
    assert model.apply(ops)["$.title"].first()["value"]["str"] == "hello"
    gone = log(spark, [("$.title", "set", {"value": "hello"}), ("$.title", "set", {})])
    assert shown(model.table(gone)) == {("$.title", None): None}


def test_fields_of_an_unnamed_struct_are_properties(spark):
    schema = T.StructType([field("owner", T.StructType([field("name", T.StringType()), field("balance", NUMBER), field("deep", T.StructType([field("tags", T.MapType(T.StringType(), T.StringType()))]))]))])
    model = Model(schema).property("$.owner.balance", "counter")
    assert set(model.bound()) == {"$.owner.name", "$.owner.balance", "$.owner.deep.tags"}
    ops = log(spark, [("$.owner.name", "set", {"value": "Ann"}), ("$.owner.balance", "increment", {"num": "2"}), ("$.owner.balance", "increment", {"num": "3"}), ("$.owner.deep.tags['it\\'s']", "map_set", {"value": "y"})])
    assert shown(model.table(ops)) == {("$.owner.name", None): "Ann", ("$.owner.balance", None): 5.0, ("$.owner.deep.tags", "it's"): "y"}
    assert model.apply(ops)["$.owner.name"].count() == 1


def test_first_writers_win_anew_after_a_clear(spark):
    schema = T.StructType([field("first", NUMBER), field("members", T.ArrayType(T.StringType())), field("entries", T.MapType(T.StringType(), NUMBER))])
    model = Model(schema).property("$.first", "fww_register").property("$.members", "fww_set").property("$.entries", "fww_map")
    rows = [("$.first", "set", {"num": "1"}), ("$.first", "clear", {}), ("$.first", "set", {"num": "7"}), ("$.members", "add", {"key": "a"}), ("$.members", "clear", {}), ("$.members", "add", {"key": "b"}), ("$.entries", "map_set", {"key": "k", "num": "1"}), ("$.entries", "clear", {}), ("$.entries", "map_set", {"key": "k", "num": "9"})]
    ops = log(spark, rows)
    want = {("$.first", None): 7.0, ("$.members", "b"): None, ("$.entries", "k"): 9.0}
    assert shown(model.table(ops)) == want
    folded = model.apply(ops)
    assert folded["$.first"].first()["num"] == 7 and [r.key for r in folded["$.members"].collect()] == ["b"] and folded["$.entries"].first()["num"] == 9
    cut = states.merged(model.state(ops.filter("global_clock <= 4")), model.state(ops.filter("global_clock > 4")))
    assert shown(states.shown(cut)) == want


def test_removes_fail_where_a_strategy_has_none(spark):
    def of(path, kind, rows):
        ops = spark.createDataFrame([("d", path, op, None if n is None else Decimal(n), r, i, i, i) for i, (op, n, r) in enumerate(rows)], "document_id string, path string, op_type string, num decimal(18,2), replica_id string, ts long, clock long, global_clock long")
        return getattr(folds, kind)(oplog.fitted(ops.withColumn("arrival", F.col("ts")))).first()

    assert of("$.p", "min_wins", [("upsert", 4, "x"), ("remove", -9, "x")])["num"] == 4
    assert of("$.p", "average_register", [("upsert", 4, "x"), ("remove", None, "x"), ("upsert", 6, "y")])["average"] == 5
    assert of("$.p", "counter", [("increment", 4, "x"), ("remove", 3, "x")])["num"] == 4
    grown = of("$.p", "g_counter", [("increment", 4, "x"), ("remove", 3, "x")])
    assert (grown["num"], grown["failed"]) == (4, 1)


def test_values_keep_their_type(spark):
    row = spark.createDataFrame([(True, 5, 2.5, "t", datetime.date(2020, 2, 3), datetime.datetime(2020, 1, 1, 2, 3, 4, 5), Decimal("1.25"), ["a", "b"], {"k": 1}, (1, "x"), float("nan"))], "b boolean, i long, f double, s string, d date, t timestamp, n decimal(10,2), a array<string>, m map<string,int>, st struct<p:int,q:string>, nan double")
    for f in row.schema.fields:
        got = row.select(values.read(values.tagged(F.col(f.name), f.dataType), f.dataType).alias("back"), F.col(f.name).alias("was"))
        assert got.filter("back = was" if f.name != "m" else "back['k'] = was['k']").count() == 1, f.name
        none = row.select(values.tagged(F.lit(None).cast(f.dataType), f.dataType).alias("v"))
        assert none.first()["v"] is None
    text = row.select(values.read(values.tagged(F.col("i"), T.LongType()), T.StringType()).alias("x"), values.read(values.text(F.lit("12")), T.LongType()).alias("y"), values.read(values.text(F.lit("no")), T.LongType()).alias("z")).first()
    assert (text.x, text.y, text.z) == ("5", 12, None)


STRATEGY = [s for s in INTENTS if s not in ("bounded_counter",)]


def random_log(spark, seed, n=60):
    rng = random.Random(seed)
    clocks, rows = {}, []
    for i in range(1, n + 1):
        r = rng.choice("xyz")
        clocks[r] = clocks.get(r, 0) + 1
        kind = "upsert" if rng.random() < 0.7 else "remove"
        rows.append((rng.choice(["d", "e"]), "$.p", kind, rng.choice("0123"), Decimal(rng.randint(-5, 9)), rng.choice(["a", "b", "c"]), f"{r}:{i}", rng.randint(0, 40), r, clocks[r], i, i, f"{r}:{i}", rng.choice([None, "vertex", "edge", "move"]), None, None, None, rng.choice([f"x:{k}" for k in range(1, i + 1)])))
    return spark.createDataFrame(rows, oplog.SCHEMA)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_every_strategy_has_a_state():
    assert set(states.STRATEGIES) == set(INTENTS)


def test_strategies_of_like_cells_are_aggregated_once(spark):
    ops = oplog.generated(spark, 300, replicas=7, keys=9)
    names = ["lww_register", "counter", "average_register", "lww_map", "or_set", "or_map", "fww_map", "fww_register", "vote_counter", "g_set"]
    got = states.partial_of_each(ops, names)
    want = states.partial(ops.withColumn("strategy", F.explode(F.array(*map(F.lit, names)))))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    once = states._partial(ops.withColumn("strategy", F.lit("lww_map")), None)
    assert once.filter("cleared IS NOT NULL")._jdf.queryExecution().optimizedPlan().maxRows().get() == 0  # told without a run


@pytest.mark.parametrize("seed", [1])
def test_states_merge_to_the_state_of_all(spark, seed):
    ops = random_log(spark, seed).withColumn("strategy", F.explode(F.array(*map(F.lit, states.STRATEGIES)))).persist()
    parts = [states.partial(ops.filter(F.pmod(F.xxhash64("global_clock"), F.lit(3)) == i)) for i in range(3)]
    whole = states.partial(ops)
    several = states.merged(states.merged(parts[2], parts[0]), parts[1])
    twice = states.merged(whole.filter(~F.col("strategy").isin("counter", "g_counter", "bounded_counter", "counter_map")), whole.filter(~F.col("strategy").isin("counter", "g_counter", "bounded_counter", "counter_map")))
    assert rows(states.shown(several)) == rows(states.shown(whole))
    assert rows(states.shown(twice)) == rows(states.shown(whole).filter(~F.col("strategy").isin("counter", "g_counter", "bounded_counter", "counter_map")))
    for name in ("lseq", "rga", "priority_queue"):
        assert rows(states.ordered(several, name)) == rows(states.ordered(whole, name)), name
    machine = {"transitions": [("a", "b"), ("b", "c"), ("c", "a")], "start": "a"}
    assert rows(states.ordered(several, "state_machine", **machine)) == rows(states.ordered(whole, "state_machine", **machine))


@pytest.mark.parametrize("seed", [3])
def test_states_show_what_folds_show(spark, seed):
    ops = random_log(spark, seed).withColumn("kind", F.lit(None).cast("string")).persist()
    for name in ("lww_register", "fww_register", "max_wins", "min_wins", "counter", "lww_map", "fww_map", "max_wins_map", "min_wins_map", "counter_map"):
        fold = getattr(folds, name)(ops)
        key = "key" if "key" in fold.columns else None
        want = sorted((r.document_id, r[key] if key else "", None if r.num is None else float(r.num)) for r in fold.collect())
        state = states.shown(states.partial(ops.withColumn("strategy", F.lit(name)))).collect()
        assert sorted((r.document_id, r.key or "", None if r.value is None else float(r.value["num"])) for r in state) == want, name
    for name in ("g_set", "two_phase_set", "lww_set", "fww_set"):
        want = sorted((r.document_id, r.key) for r in getattr(folds, name)(ops).collect())
        state = states.shown(states.partial(ops.withColumn("strategy", F.lit(name)))).collect()
        assert sorted((r.document_id, r.key) for r in state) == want, name
    want = sorted((r.document_id, r.key) for r in folds.or_set(ops, folds.observed_tags(ops)).collect())
    assert sorted((r.document_id, r.key) for r in states.shown(states.partial(ops.withColumn("strategy", F.lit("or_set")))).collect()) == want


@pytest.mark.parametrize("seed", [5])
def test_compaction_changes_no_value_and_drops_something(spark, seed):
    ops = random_log(spark, seed, 120).withColumn("strategy", F.explode(F.array(*map(F.lit, states.STRATEGIES)))).persist()
    whole = states.partial(ops)
    minimum = ops.groupBy(F.col("replica_id").alias("origin")).agg(F.max("clock").alias("version"))
    small = states.compacted(whole, 30, minimum)
    assert small.count() < whole.count()
    assert rows(states.shown(small)) == rows(states.shown(whole))


def test_a_tag_whose_remove_is_not_everywhere_stays(spark):
    rows_ = [("d", "$.s", "upsert", "a", "x:1", 1, "x", 1), ("d", "$.s", "remove", "a", "x:2", 2, "x", 2)]
    ops = oplog.fitted(spark.createDataFrame(rows_, "document_id string, path string, op_type string, key string, tag string, ts long, replica_id string, clock long"))
    minimum = lambda v: spark.createDataFrame([("x", v)], "origin string, version long")
    kept = lambda v: retention.compact_or_set(ops, folds.observed_tags(ops), minimum(v)).count()
    assert (kept(1), kept(2)) == (1, 0)  # the add alone being everywhere isn't enough


def test_an_or_map_shows_after_compaction_what_it_showed(spark):
    rows_ = [("d", "$.m", "upsert", "k", "y:1", 1, "y", 1, Decimal(1)), ("d", "$.m", "upsert", "k", "x:1", 5, "x", 1, Decimal(2)), ("d", "$.m", "remove", "k", "x:2", 6, "x", 2, None)]
    ops = oplog.fitted(spark.createDataFrame(rows_, "document_id string, path string, op_type string, key string, tag string, ts long, replica_id string, clock long, num decimal(18,2)"))
    minimum = spark.createDataFrame([("x", 2)], "origin string, version long")
    (left,) = retention.compact_or_map(ops, folds.observed_tags(ops), minimum).collect()
    assert (left.tag, left.num) == ("y:1", 2) and folds.or_map(ops, folds.observed_tags(ops)).first()["num"] == 2


def test_a_model_compacts_each_entry_by_itself(spark):
    model = Model(T.StructType([field("m", T.MapType(T.StringType(), NUMBER)), field("s", T.ArrayType(T.StringType()))])).property("$.s", "or_set")
    ops = log(spark, [("$.m['a']", "map_set", {"num": "1"}), ("$.m['b']", "map_set", {"num": "2"}), ("$.s", "add", {"key": "e"}), ("$.s", "remove_value", {"key": "e"})])
    out = retention.compact_model(model, ops, 100, spark.createDataFrame([("x", 9)], "origin string, version long"))
    assert sorted(r.key for r in out["$.m"].collect()) == ["a", "b"] and out["$.s"].count() == 0


def test_ranks_sums_and_neighbours_in_two_levels(spark):
    rng = random.Random(8)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(1, 9)) for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, i long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranks.in_shares(df, ["g"], ["i"]).select(ranks.SHARE).distinct().count() > 1
        got = {r.i: (r.rank, r.upto, r.before, r.after) for r in ranks.neighboured(ranks.neighboured(ranks.summed(ranks.ranked(df, ["g"], ["i"]), ["g"], ["i"], "v"), ["g"], ["i"], {"before": "i"}), ["g"], ["i"], {"after": "i"}, step=1).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 500
    for g in ("hot", "a", None):
        mine = sorted((i, v) for x, i, v in data if x == g)
        total = 0
        for k, (i, v) in enumerate(mine):
            total += v
            assert got[i] == (k + 1, total, mine[k - 1][0] if k else None, mine[k + 1][0] if k + 1 < len(mine) else None)


def test_one_scan_for_a_model_of_many_fields(spark, tmp_path):
    from confluo.plans.queries import nested_model

    random_log(spark, 9).write.parquet(str(tmp_path / "log"))
    plan = nested_model().table(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_model_without_first_writers_reads_its_log_when_its_table_is_read(spark):
    model = Model(T.StructType([field("a", T.StringType()), field("tags", T.MapType(T.StringType(), T.StringType()))]))
    rows = log(spark, [("$.a", "set", {"value": "1"}), ("$.a", "set", {"value": "2"}), ("$.tags['k']", "map_set", {"value": "3"}), ("$.a|epoch", "set", {"value": "4"}), ("$.b", "set", {"value": "5"})])
    spark.sparkContext.setJobGroup("no job yet", "")
    try:
        table = model.table(rows)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("no job yet")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r["path"], r["key"], r["value"]["str"]) for r in table.collect()} == {("$.a", None, "4"), ("$.tags", "k", "3")}


def test_typed_registers_read_events_once(spark):
    plan = queries.typed_registers(spark, "/root/testdata/sf0.001").select("*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("RelationV2") == 1
