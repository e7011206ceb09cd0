from confluo.operators import diffs, partitions, retention, sync
from confluo.plans import intents
from confluo.plans.registry import Model, StrategySpec
from confluo.functions import paths
from pyspark.sql import functions as F
from pyspark.sql import types as T
import pytest

VV = "origin string, contiguous long, dots array<bigint>"


def vector(spark, *rows):
    return spark.createDataFrame(list(rows), VV)


def test_prefix_and_dots(spark):
    seen = spark.createDataFrame([("a", v) for v in (1, 2, 3, 5, 7, 7)] + [("b", 2)], "origin string, v long")
    got = {r["origin"]: (r["contiguous"], r["dots"]) for r in sync.dotted_vector(seen, ["origin"], "v").collect()}
    assert got == {"a": (3, [5, 7]), "b": (0, [2])}


def test_merge_absorbs_dots(spark):
    got = sync.merged(vector(spark, ("a", 3, [5]), ("a", 1, [4, 7])), ["origin"]).first()
    assert (got["contiguous"], got["dots"]) == (5, [7])


def test_requirement_cases(spark):
    need = lambda t, s: [(r["origin"], r["target_contiguous"], r["source_contiguous"], r["known"], r["missing"]) for r in sync.requirements(t, s).collect()]
    empty = vector(spark)
    assert need(empty, empty) == []
    assert need(vector(spark, ("a", 9, [])), vector(spark, ("a", 5, []))) == []
    assert need(empty, vector(spark, ("a", 5, []))) == [("a", 0, 5, [], [])]
    assert need(vector(spark, ("a", 2, [4])), vector(spark, ("a", 5, []))) == [("a", 2, 5, [4], [])]
    assert need(vector(spark, ("a", 5, [])), vector(spark, ("a", 5, [8]))) == [("a", 5, 5, [], [8])]


def test_journal_gap_asks_for_snapshot(spark):
    required = sync.requirements(vector(spark), vector(spark, ("a", 4, [6])))
    journal = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 6)], "replica_id string, global_clock long")
    assert sync.missing_operations(required, journal).count() == 5
    assert not sync.journal_completeness(required, journal).first()["snapshot_required"]
    for lost in (1, 3, 6):
        assert sync.journal_completeness(required, journal.filter(F.col("global_clock") != lost)).first()["snapshot_required"]


def test_global_vectors(spark):
    v = spark.createDataFrame([("x", "a", 3, [5, 9]), ("y", "a", 5, [7]), ("x", "b", 2, [])], "replica_id string, " + VV)
    assert [tuple(r) for r in sync.global_minimum(v, 2).collect()] == [("a", 3)]
    assert {r["origin"]: (r["contiguous"], r["dots"]) for r in sync.global_maximum(v).collect()} == {"a": (5, [7, 9]), "b": (2, [])}


def test_rga_compaction_cascades(spark):
    nodes = spark.createDataFrame([("d", 1, None, True, True), ("d", 2, 1, True, True), ("d", 3, None, True, True), ("d", 4, 3, False, True)], "document_id string, id long, left_id long, deleted boolean, safe boolean")
    assert sorted(r["id"] for r in retention.compact_rga(nodes).collect()) == [3, 4]


def test_routing_agrees_with_lookup_in_one_block_and_in_many(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 49 == 0, "other").otherwise("g").alias("g"), (F.col("id") * 37 % 211).alias("k"))
    rows = rows.unionByName(spark.createDataFrame([("g", None), ("g", -5)], "g string, k long"))
    ranges = partitions.catalog(rows.filter("g = 'g' AND k >= 0"), "g", "k", 60)
    key = lambda r: (str(r["g"]), r["k"] is None, r["k"], r["part"])
    once = sorted(map(key, partitions.route(rows, ranges, "g", "k").collect()))
    keep, partitions.BROADCAST_RANGES = partitions.BROADCAST_RANGES, 2
    try:
        blocks = sorted(map(key, partitions.route(rows, ranges, "g", "k").collect()), key=str)
    finally:
        partitions.BROADCAST_RANGES = keep
    assert sorted(once, key=str) == blocks and len(once) == 502  # rows without a range stay
    found = {(g, k): part for g, _, k, part in once}
    assert found["g", -5] is None and found["g", None] is None and all(v is None for (g, _), v in found.items() if g != "g")
    for k in (0, 100, 210):
        assert partitions.lookup(ranges, "g", "g", k).first()["part"] == found["g", k]


def test_recursive_split(spark):
    rows = spark.range(1000).select(F.lit("g").alias("g"), F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("k"))
    whole = partitions.catalog(rows, "g", "k", 1 << 40)
    parts = sorted(partitions.split(whole, rows, "g", "k", 50, again=True).collect(), key=lambda r: r["start_key"])
    assert sum(r["n_rows"] for r in parts) == 1000 and [r["part"] for r in parts] == list(range(len(parts)))
    assert all(r["n_rows"] <= 50 or (r["start_key"], r["n_rows"]) == (7, 300) for r in parts)
    assert [r["end_key"] for r in parts] == [r["start_key"] for r in parts[1:]] + [None]


def test_path_ids_lie_between(spark):
    import random

    rng = random.Random(3)
    made = [[rng.randrange(32) for _ in range(rng.randint(1, 4))] for _ in range(60)] + [[0], [31], [31, 31], [5], [6], [5, 31], [5, 0]]
    made = sorted({tuple(x) for x in made if x[-1] != 0 or x == [0]})
    pairs = [(list(a), list(b)) for a, b in zip(made, made[1:])] + [(list(made[-1]), None), (None, [9])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>")
    for r in df.select("a", "b", diffs.path_between(F.col("a"), F.col("b")).alias("m")).collect():
        assert (r["a"] or []) < r["m"] and (r["b"] is None or r["m"] < r["b"]), r


@pytest.mark.parametrize("a, b", [("", "abc"), ("abc", ""), ("abcbdab", "bdcaba"), ("xaby", "xbay"), ("aaa", "aa")])
def test_lcs_rebuilds(a, b):
    kept = diffs.lcs_pairs(list(a), list(b))
    assert all(a[i] == b[j] for i, j in kept) and kept == sorted(kept) and len({j for _, j in kept}) == len(kept)


def test_model_and_intents(spark):
    schema = T.StructType([T.StructField("Name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    m = Model(schema)
    assert [m.resolve(p).name for p in ("$.name", "$.tags", "$.m", "$.x", "$.x[0]")] == ["lww_register", "array_lcs", "lww_map", "lww_register", "array_lcs"]
    m.property("$.name", "counter").property("$.tags", "or_set").decorate("$.tags", "epoch_bound")
    assert m.validate() == ["$.name: counter needs a number, not string"]
    assert m.resolve("$.tags").intents() == {"add", "remove_value", "remove", "epoch_clear"}
    with pytest.raises(NotImplementedError):
        intents.record("d", "$.name", StrategySpec("max_wins"), "increment", value=1)
    got = intents.operations(spark, [intents.record("d", "$.m", StrategySpec("lww_map"), "map_set", key="k", value=3), intents.record("d", "$.m", StrategySpec("lww_map"), "map_remove", key="k")], "r", 100)
    assert [(r["op_type"], r["key"], r["clock"], r["ts"]) for r in got.orderBy("ts").collect()] == [("upsert", "k", 1, 100), ("remove", "k", 2, 101)]


def test_paths(spark):
    assert paths.parse("$.a.b[2]['x\\'y']") == ["a", "b", 2, "x'y"]
    row = spark.range(1).select(F.lit("$.a[0]['k']").alias("p"))
    assert row.select(paths.segments(F.col("p")), paths.parent(F.col("p"))).first()[:] == (["a", "0", "k"], "$.a[0]")
    tests = row.select(*(paths.within(F.lit(p), "$.a") for p in ("$.a", "$.a.b", "$.a[1]", "$.ab", "$.a|EpochBound")))
    assert tuple(tests.first()) == (True, True, True, False, True)


def test_lcs_diff_rebuilds_whole_turns(spark):
    from confluo.plans.queries import lcs_diff

    d = "/root/testdata/sf0.001"
    turns = {(r["conv_id"], r["turn"]): r["text"].split(" ") for r in spark.read.parquet(f"{d}/conversations.parquet").collect()}
    changes = {}
    for r in lcs_diff(spark, d).collect():
        changes.setdefault(r["pair"], ({}, {}))[r["op_type"] == "upsert"][r["place"]] = r["value"]
    assert max(map(len, turns.values())) > 60
    for (conv, turn), new in turns.items():
        if (conv, turn - 1) in turns:
            removed, added = changes.get(f"{conv}/{turn}", ({}, {}))
            kept = iter(w for i, w in enumerate(turns[conv, turn - 1]) if i not in removed)
            assert [added[i] if i in added else next(kept) for i in range(len(new))] == new


def test_lcs_is_longest_and_of_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(10))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = diffs.lcs_pairs(a, b)
        assert len(kept) == best[-1][-1] and all(a[i] == b[j] for i, j in kept)
    a, b = ([rng.randrange(500) for _ in range(1500)] for _ in range(2))
    tracemalloc.start()
    diffs.lcs_pairs(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_walks_go_to_the_end_of_a_chain(spark, monkeypatch):
    from confluo.operators import folds

    local = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  quicker than files for so few rows
    monkeypatch.setattr(folds, "saved", local)
    chain = local(spark.range(67).selectExpr("id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent"))
    assert sorted(tuple(r) for r in folds.tree_depths(chain).collect()) == [(i, i) for i in range(67)]


def test_values_are_set_in_arrays_and_maps(spark):
    from pyspark.sql import types as T

    from confluo.functions.paths import value_at, with_value

    kind = "d struct<t: array<struct<x: int>>, m: map<string, int>, n: map<int, map<string, string>>, s: struct<y: int>>"
    rows = spark.createDataFrame([(([(1,), (2,)], {"k": 1}, {7: {"a": "b"}}, None),), ((None, None, None, None),)], kind)
    type_ = rows.schema["d"].dataType
    d, seven = F.col("d"), F.lit(7)

    def put(path, value, **how):
        return [r[0] for r in rows.select(with_value(d, path, value, **how).alias("d")).collect()]

    assert [x.x for x in put("$.t[1].x", seven)[0].t] == [1, 7] and put("$.t[1].x", seven)[1].t is None
    assert [x.x for x in put("$.t[5].x", seven)[0].t] == [1, 2]
    assert put("$.m['k']", seven)[0].m == {"k": 7} and put("$.m['new']", seven)[0].m == {"k": 1, "new": 7} and put("$.m['k']", seven)[1].m is None
    assert put("$.n['7']['a']", F.lit("c"), kind=type_)[0].n == {7: {"a": "c"}}
    assert put("$.s.y", seven)[0].s is None and put("$.s.y", seven, kind=type_, create=True)[0].s.y == 7
    assert put("$.m['k']", seven, kind=type_, create=True)[1].m == {"k": 7}
    with pytest.raises(ValueError):
        put("$.s.z", seven, kind=T.StructType(type_.fields))
    assert rows.select(value_at(d, "$.m['k']").alias("v")).first()["v"] == 1


def test_scans_of_a_journal_read_the_folders_they_need(spark, tmp_path):
    from confluo.sources import oplog

    folder = str(tmp_path / "journal")
    ops = oplog.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    oplog.append(ops, folder)
    dots = spark.createDataFrame([("7", g) for g in range(1, 900)], "replica_id string, global_clock long")
    dots.write.parquet(str(tmp_path / "dots"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the scans' figures can be found in the plan
    try:
        got = oplog.at_dots(oplog.scanned(spark, folder), spark.read.parquet(str(tmp_path / "dots")))
        assert len(got.collect()) == ops.filter("replica_id = '7' AND global_clock < 900").count() > 0
        leaves = got._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        read = {s.relation().location().rootPaths().head().getName(): s.metrics().get("numFiles").get().value() for s in scans if s.nodeName().startswith("Scan parquet")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read["journal"] == 1 and len(spark.read.parquet(folder).inputFiles()) > 10
    one = oplog.in_range(oplog.read_journal(spark, folder), "7", 5, 500)
    assert "replica_id" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_many_parts_share_folders_and_one_is_overwritten_alone(spark, tmp_path):
    import os

    from confluo.operators import delivery

    folder = str(tmp_path / "parts")
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 2500).cast("int").alias("part"), F.col("id").alias("k"))
    delivery.save_partitions(rows, folder, ["g", "part"])
    assert sum(len(d) for _, d, _ in os.walk(folder)) <= 2 + 2 * 3
    delivery.save_partitions(rows.filter("part IN (1, 2400)").withColumn("k", F.col("k") + 1_000_000), folder, ["g", "part"])
    changed = F.when(F.col("part").isin(1, 2400), F.col("k") + 1_000_000).otherwise(F.col("k"))
    got = spark.read.parquet(folder).select("g", "part", "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.withColumn("k", changed).collect()))
    header = spark.createDataFrame([("a", 1), ("z", 2)], "g string, label int")
    whole = partitions.reassembled(header, got, "g")
    assert whole.columns == ["g", "label", "part", "k"]
    assert whole.filter("g = 'a'").count() == 3000 and [tuple(r) for r in whole.filter("g <> 'a'").collect()] == [("z", 2, None, None)]


def test_a_journal_of_many_origins_has_few_folders(spark, tmp_path):
    import os

    from confluo.sources import oplog

    folder = str(tmp_path / "journal")
    ops = oplog.generated(spark, 3000, replicas=1500)
    oplog.append(ops, folder)
    oplog.append(ops.filter("global_clock % 10 = 0"), folder)
    assert len([x for x in os.listdir(folder) if "=" in x]) <= oplog.JOURNAL_BUCKETS
    journal = oplog.read_journal(spark, folder)
    assert sorted(map(str, journal.select(ops.columns).collect())) == sorted(map(str, ops.collect()))
    assert oplog.in_range(journal, "r7", 0, 1 << 40).count() == ops.filter("replica_id = 'r7'").count() == 2


def test_edits_are_handed_on_as_they_come():
    import pyarrow as pa

    n = 3000
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([["a"] * 10] * n), pa.array([["b"] * 5] * (n - 1) + [None])], ["key", "old", "new"])
    out = list(diffs.edit_batches([batch]))
    assert len(out) > 1 and max(b.num_rows for b in out) <= diffs.EDITS + 15
    assert sum(b.num_rows for b in out) == n * 15 - 5


def test_sides_of_a_diff_are_dealt_to_parts_however_small_their_shuffle_is(spark):
    numbers = lambda low, high: spark.range(low, high, numPartitions=2).select(F.col("id").alias("k"), F.col("id").alias("v"))
    old, new = numbers(0, 200_000), numbers(100_000, 300_000)
    found = diffs.set_diff(old, new, ["k"]).withColumn("task", F.spark_partition_id())
    assert {(r["op_type"], r["n"], r["low"]) for r in found.groupBy("op_type").agg(F.count("*").alias("n"), F.min("k").alias("low")).collect()} == {("remove", 100_000, 0), ("upsert", 100_000, 200_000)}
    assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 3_000
    tasks = diffs.map_diff(old, new, ["k"], "v").withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert tasks.agg(F.max("count")).first()[0] < 3_000


def test_set_diff_with_nulls_and_repeats(spark):
    pairs = lambda *rows: spark.createDataFrame(list(rows), "a string, b long")
    got = diffs.set_diff(pairs(("x", 1), ("x", 1), ("y", None), (None, None)), pairs(("x", 1), ("z", 2), ("z", 2), ("y", None)), ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("z", 2, "upsert"), ("y", None, "upsert"), ("y", None, "remove"), (None, None, "remove")], key=str)
