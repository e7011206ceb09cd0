"""Lists: order by list ranking, composite ids, indices as places of a replica's own list."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confluo.functions import keys
from confluo.operators import sequences, states
from confluo.plans import intents
from confluo.plans.registry import Model
from confluo.sources import oplog


def walk(nodes):
    """Depth first, newest sibling first, by recursion with a stack."""
    known = {i for i, _, _ in nodes}
    below = {}
    for i, left, _ in nodes:
        below.setdefault(left if left in known else None, []).append(i)
    out, stack = [], sorted(below.get(None, []))
    while stack:
        i = stack.pop()
        out.append(i)
        stack.extend(sorted(below.get(i, [])))
    return out


def frame(spark, lists):
    return spark.createDataFrame([(d, i, left, gone) for d, nodes in lists.items() for i, left, gone in nodes], "document_id string, id long, left_id long, deleted boolean")


def places(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.document_id, []).append((r.place, r.id))
    return {d: [i for _, i in sorted(x)] for d, x in out.items()}


def random_list(rng, n, typed):
    nodes = []
    for i in range(1, n + 1):
        left = i - 1 if nodes and rng.random() < typed else rng.choice([None, 10**9, *(x[0] for x in nodes[-50:])])
        nodes.append((i, left or None, rng.random() < 0.2))
    return nodes


@pytest.mark.parametrize("typed", [0.0, 0.95])
def test_ranking_equals_a_walk(spark, monkeypatch, typed):
    rng = random.Random(7)
    lists = {f"d{k}": random_list(rng, n, typed) for k, n in enumerate((1, 2, 300, 700))}
    want = {d: walk(nodes) for d, nodes in lists.items()}
    assert places(sequences.rga_order(frame(spark, lists))) == want
    monkeypatch.setattr(sequences, "WALKED", 100)  # the two long ones are ranked
    assert places(sequences.rga_order(frame(spark, lists))) == want


def test_a_long_chain_and_a_wide_list(spark, monkeypatch):
    monkeypatch.setattr(sequences, "WALKED", 0)
    chain = [(i, i - 1 if i > 1 else None, False) for i in range(1, 20_001)]
    wide = [(i, None, False) for i in range(1, 3001)]
    got = places(sequences.rga_order(frame(spark, {"chain": chain, "wide": wide})))
    assert got["chain"] == list(range(1, 20_001)) and got["wide"] == list(range(3000, 0, -1))


def test_cycles_have_no_place_and_repeated_nodes_are_one(spark, monkeypatch):
    nodes = [(1, None, False), (1, None, True), (2, 1, False), (5, 6, False), (6, 5, False), (7, 6, False)]
    for limit in (100, 0):
        monkeypatch.setattr(sequences, "WALKED", limit)
        got = sequences.rga_order(frame(spark, {"d": nodes}))
        assert sorted((r.id, r.place, r.deleted) for r in got.collect()) == [(1, 1, True), (2, 2, False)]


def test_pieces_are_a_list():
    rng = random.Random(1)
    pieces, plain = sequences.Pieces(40), [("old", i) for i in range(40)]
    pieces.BLOCK = 4
    for k in range(3000):
        assert len(pieces) == len(plain)
        if plain and rng.random() < 0.5:
            i = rng.randrange(len(plain))
            place, name = pieces.at(i)
            assert plain[i] == (("old", place) if name is None else ("new", name))
            pieces.remove(i)
            plain.pop(i)
        else:
            i = rng.randint(0, len(plain))
            pieces.insert(i, str(k))
            plain.insert(i, ("new", str(k)))


def test_positions_lie_between():
    rng = random.Random(2)
    for between in (sequences.fraction_between, sequences.path_key_between):
        found = []
        for k in range(150):  # halves of halves need up to 29 digits
            i = rng.randint(0, len(found)) if k % 3 else len(found)
            low, high = (found[i - 1] if i else None), (found[i] if i < len(found) else None)
            new = between(low, high, rng.choice("ab"))
            if between is sequences.path_key_between or k < 80:
                assert (low is None or low < new) and (high is None or new < high)
            found.insert(i, new)


EDITS = "document_id string, path string, replica_id string, intent string, index int, value string, ts long, clock long, global_clock long"


def edit(replica, clock, intent, index=None, value=None, doc="d"):
    return (doc, "$.list", replica, intent, index, value, clock, clock, clock)


@pytest.mark.parametrize("strategy", ["array_lcs", "lseq", "rga"])
def test_edits_by_index_are_a_list_to_their_replica(spark, strategy):
    """Random edits of one replica on a list of another's give what a plain list gives."""
    rng = random.Random(3)
    schema = Model(oplog.T.StructType([oplog.T.StructField("list", oplog.T.ArrayType(oplog.T.StringType()))])).property("$.list", strategy)
    base = [edit("x", c, "add", None, f"x{c}", doc) for doc in "de" for c in range(1, 6)]
    plain = {doc: [f"x{c}" for c in range(1, 6)] for doc in "de"}
    log, rejected = intents.edited(spark.createDataFrame(base, EDITS), oplog.fitted(spark.createDataFrame([], EDITS).drop("value")), strategy)
    assert rejected.count() == 0
    log = log.persist()
    later, wrong = [], 0
    for c in range(101, 141):
        doc = rng.choice("de")
        now, kind = plain[doc], rng.choice(["add", "insert", "insert", "remove", "bad"])
        if kind == "bad":
            wrong += 1
            later.append(edit("y", c, rng.choice(["insert", "remove"]), rng.choice([-1, 99]), "no", doc))
        elif kind == "remove":
            if now:
                i = rng.randrange(len(now))
                now.pop(i)
                later.append(edit("y", c, "remove", i, None, doc))
        else:
            i = len(now) if kind == "add" else rng.randint(0, len(now))
            now.insert(i, f"y{c}")
            later.append(edit("y", c, kind, None if kind == "add" else i, f"y{c}", doc))
    news, rejected = intents.edited(spark.createDataFrame(later, EDITS), log, strategy)
    assert rejected.count() == wrong
    state = schema.apply(log.unionByName(news))["$.list"]
    rows = state.filter("NOT deleted") if strategy == "rga" else state
    got = {}
    for r in rows.orderBy("place").collect():
        got.setdefault(r.document_id, []).append(r.value["str"])
    assert got == plain


def test_elements_of_equal_clocks_are_each_there_once(spark):
    rows = [("d", "$.list", "upsert", r, c, c, c, c, None if c == 1 else left, {"kind": "s", "num": None, "str": f"{r}{c}"}) for r, left in (("a", keys_of(1, "a")), ("b", keys_of(1, "a"))) for c in (1, 2)]
    log = spark.createDataFrame(rows, "document_id string, path string, op_type string, replica_id string, ts long, clock long, global_clock long, arrival long, ref string, value struct<kind string, num decimal(38,10), str string>")
    model = Model(oplog.T.StructType([oplog.T.StructField("list", oplog.T.ArrayType(oplog.T.StringType()))])).property("$.list", "rga")
    got = model.apply(oplog.fitted(log))["$.list"].orderBy("place").collect()
    assert [r.value["str"] for r in got] == ["b1", "a1", "b2", "a2"]


def keys_of(clock, replica):
    return f"{clock + 2**63:016x}{replica}"


def test_ordered_keys(spark):
    longs = [-(2**63), -5, -1, 0, 1, 7, 2**40, 2**63 - 1]
    got = spark.createDataFrame([(x,) for x in longs], "x long").select("x", keys.of_long(F.col("x")).alias("k"), keys.to_long(keys.of_long(F.col("x"))).alias("back")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.k)] == longs and all(r.x == r.back for r in got)
    numbers = [str(x) for x in (-1000, -12.5, -12.4, -1, -0.0001, 0, 0.25, 3, 3.5, 22, 1e9)]
    got = spark.createDataFrame([(x,) for x in numbers], "x string").select("x", keys.of_number(F.col("x").cast("decimal(38,10)")).alias("k")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.k)] == numbers
    paths = [[(1, "a")], [(1, "a"), (0, "")], [(1, "a"), (1, "b")], [(1, "a\x00b")], [(1, "a\x01")], [(1, "ab")], [(2, "")], [(10, "a")]]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, p array<struct<position long, replica string>>").select("i", keys.of_path(F.col("p")).alias("k")).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.k)] == list(range(len(paths)))
    assert sequences.path_key([(1, "a"), (0, "")]) == got[1].k


def test_rows_are_read_column_by_column():
    batch = pa.RecordBatch.from_pydict({"s": pa.array(["a", None, "b"]), "i": pa.array([1, None, 2**62 + 1]), "t": pa.array([True, None, False]), "n": pa.array([None] * 3, pa.int64())})
    assert list(sequences.listed_rows(batch)) == batch.to_pylist()
    assert list(sequences.listed_rows(batch.slice(0, 0))) == []


def test_cells_of_lists_are_grouped_once(spark):
    rows = [("d", "$.l", "upsert", "v", f"t{i}", i, "x", i, i, "lseq", f"p{i}") for i in range(5)] + [("d", "$.l", "remove", None, None, 9, "y", 1, 9, "lseq", None)]
    ops = spark.createDataFrame(rows, "document_id string, path string, op_type string, str string, tag string, ts long, replica_id string, clock long, global_clock long, strategy string, pos string")
    log = oplog.fitted(ops.withColumns({"arrival": F.col("global_clock"), "ref": F.when(F.col("op_type") == "remove", "t2")})).withColumn("strategy", F.lit("lseq"))
    state = states.partial(log, ["lseq"])
    columns = [*states.KEYS[:-1], *(c for c in states.COMBINE)]
    assert sorted(map(str, states.joined(state, parts=False).select(columns).collect())) == sorted(map(str, states.joined(state).select(columns).collect()))
    assert [(r["key"], r["place"]) for r in states.listed(state, ("lseq",)).orderBy("place").collect()] == [("t0", 1), ("t1", 2), ("t3", 3), ("t4", 4)]
    plan = states.joined(state, parts=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
