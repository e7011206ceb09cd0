"""The library's queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions import keys, paths, values
from confluo.operators import delivery, diffs, folds, partitions, ranks, retention, states, sync
from confluo.plans import intents
from confluo.plans.registry import Model
from confluo.session import saved, shared_folder, table
from confluo.sources import oplog
from confluo.streaming import apply as streams
from confluo.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OPS = """ops AS (
  SELECT event_type AS document_id, '$.state' AS path, CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'upsert' END AS op_type,
    json_extract_string(props, '$.k') AS key, CAST(CAST(value AS DECIMAL(18,2)) * CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS DECIMAL(18,2)) AS num,
    'v' || (event_id % 1000) AS str, epoch_us(ts) AS ts, CAST(user_id AS VARCHAR) AS replica_id, event_id AS global_clock,
    event_id * 7919 % 1000003 AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS clock, CAST(user_id AS VARCHAR) || ':' || event_id AS tag
  FROM events)"""
#: A state pair for diffs: what two thirds of the operations give, and what all give.
MAPS = OPS + """, old_map AS (
  SELECT document_id, key, num FROM (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY ts DESC, replica_id DESC, global_clock DESC) AS rn FROM ops WHERE global_clock % 3 <> 0) WHERE rn = 1 AND op_type = 'upsert'
), new_map AS (
  SELECT document_id, key, num FROM (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY ts DESC, replica_id DESC, global_clock DESC) AS rn FROM ops) WHERE rn = 1 AND op_type = 'upsert')"""
#: Dotted version vectors of three holders: each saw part of every origin's operations.
VECTORS = OPS + """, seen AS (
  SELECT 'h' || h AS replica_id, o.replica_id AS origin, clock FROM ops o, (SELECT unnest([0, 1, 2]) AS h) WHERE (clock <= 3 * (h + 1) OR clock % (h + 2) = 0)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY replica_id, origin ORDER BY clock) AS rn FROM seen),
vectors AS (SELECT replica_id, origin, coalesce(max(clock) FILTER (WHERE clock = rn), 0) AS contiguous, coalesce(list(clock ORDER BY clock) FILTER (WHERE clock <> rn), []) AS dots FROM numbered GROUP BY 1, 2)"""


def ops(spark: SparkSession, d: str) -> DataFrame:
    return oplog.from_events(table(spark, d, "events"))


def query(sql: str | None = None, with_: str = OPS):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {with_} {sql}" if with_ else sql
        return f

    return add


UP = "op_type = 'upsert'"


def real(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def won(by: str, way: str = "DESC", where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts {way}, replica_id {way}, global_clock {way}) AS rn FROM ops WHERE {where}) WHERE rn = 1)"


# registers


@query(f"SELECT document_id, ts, replica_id, CASE WHEN op_type = 'upsert' THEN CAST(num AS DOUBLE) END AS num FROM {won('document_id')}")
def lww_register(spark, d):
    return folds.lww_register(ops(spark, d)).select("document_id", "ts", "replica_id", *real("num"))


@query(f"""SELECT document_id, ts, replica_id, CASE WHEN op_type = 'upsert' THEN CAST(num AS DOUBLE) END AS num FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, replica_id, global_clock) AS rn FROM ops JOIN
  (SELECT document_id, max(arrival) FILTER (WHERE global_clock % 101 = 0) AS last FROM ops GROUP BY 1) USING (document_id) WHERE last IS NULL OR arrival > last) WHERE rn = 1""")
def fww_register(spark, d):
    return folds.fww_register(ops(spark, d), F.col("global_clock") % 101 == 0).select("document_id", "ts", "replica_id", *real("num"))


@query("SELECT document_id, CAST(max(num) AS DOUBLE) AS num FROM ops WHERE op_type = 'upsert' GROUP BY 1")
def max_wins(spark, d):
    return folds.max_wins(ops(spark, d)).select("document_id", *real("num"))


@query("SELECT document_id, CAST(min(num) AS DOUBLE) AS num FROM ops WHERE op_type = 'upsert' GROUP BY 1")
def min_wins(spark, d):
    return folds.min_wins(ops(spark, d)).select("document_id", *real("num"))


@query(f"SELECT document_id, round(CAST(sum(num) AS DOUBLE) / count(*), 6) AS average, count(*) AS replicas FROM {won('document_id, replica_id', 'DESC', UP)} GROUP BY 1")
def average_register(spark, d):
    return folds.average_register(ops(spark, d)).select("document_id", F.round("average", 6).alias("average"), "replicas")


@query("""SELECT document_id, slot, CAST(coalesce(num, 0) AS DOUBLE) AS num FROM (SELECT document_id, slot FROM (SELECT DISTINCT document_id FROM ops), (SELECT unnest(range(8)) AS slot)) LEFT JOIN
  (SELECT document_id, slot, num FROM (SELECT *, CAST(key AS BIGINT) % 9 AS slot, row_number() OVER (PARTITION BY document_id, CAST(key AS BIGINT) % 9 ORDER BY ts DESC, replica_id DESC) AS rn FROM ops) WHERE rn = 1) USING (document_id, slot)""")
def fixed_size_array(spark, d):
    return folds.fixed_size_array(ops(spark, d), 8, F.col("key").cast("int") % 9).select("document_id", F.col("slot").cast("long").alias("slot"), *real("num"))


STATES = ["created", "in_progress", "completed"]


@query(f""", moves AS (SELECT document_id || '/' || replica_id AS machine, ['{"', '".join(STATES)}'][CAST(key AS INT) % 3 + 1] AS dest, ts, row_number() OVER (PARTITION BY document_id, replica_id ORDER BY arrival, global_clock) AS n FROM ops),
 run AS (SELECT machine, 0::BIGINT AS n, 'created' AS state, NULL::BIGINT AS ts, 0 AS rejected FROM (SELECT DISTINCT machine FROM moves) UNION ALL
  SELECT r.machine, m.n, CASE WHEN ok AND (r.ts IS NULL OR m.ts > r.ts) THEN dest ELSE state END, CASE WHEN ok AND (r.ts IS NULL OR m.ts > r.ts) THEN m.ts ELSE r.ts END, rejected + CASE WHEN ok THEN 0 ELSE 1 END
  FROM run r JOIN moves m ON m.machine = r.machine AND m.n = r.n + 1, LATERAL (SELECT (state, dest) IN (('created', 'in_progress'), ('in_progress', 'completed'), ('completed', 'created')) AS ok))
 SELECT machine, state, rejected FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY n DESC) AS rn FROM run) WHERE rn = 1""")
def state_machine(spark, d):
    machines = ops(spark, d).withColumn("document_id", F.concat_ws("/", "document_id", "replica_id"))
    steps = list(zip(STATES, STATES[1:] + STATES[:1]))
    allowed = lambda a, b: F.concat_ws(">", a, b).isin([f"{x}>{y}" for x, y in steps])
    target = F.get(F.array(*map(F.lit, STATES)), F.col("key").cast("int") % 3)
    return folds.state_machine(machines, target, allowed, "created").select(F.col("document_id").alias("machine"), "state", "rejected")


# counters


@query(f"SELECT document_id, CAST(sum(num) AS DOUBLE) AS num FROM ops WHERE {UP} GROUP BY 1")
def counter(spark, d):
    return folds.counter(ops(spark, d)).select("document_id", *real("num"))


@query(f"SELECT document_id, CAST(sum(num) FILTER (WHERE num > 0 AND {UP}) AS DOUBLE) AS num, count(*) FILTER (WHERE num <= 0 OR NOT {UP}) AS failed FROM ops GROUP BY 1")
def gcounter(spark, d):
    return folds.g_counter(ops(spark, d)).select("document_id", *real("num"), "failed")


@query(f"SELECT document_id, CAST(sum(num) AS DOUBLE) AS num, greatest(0.0::DOUBLE, least(100000.0::DOUBLE, CAST(sum(num) AS DOUBLE))) AS shown FROM ops WHERE {UP} GROUP BY 1")
def bounded_counter(spark, d):
    return folds.bounded_counter(ops(spark, d), 0, 100000).select("document_id", *real("num"), "shown")


@query("SELECT document_id, replica_id, clock, greatest(-500.0::DOUBLE, least(500.0::DOUBLE, CAST(sum(num) OVER (PARTITION BY document_id, replica_id ORDER BY clock) AS DOUBLE))) AS shown FROM ops WHERE op_type = 'upsert'")
def bounded_counter_running(spark, d):
    return folds.bounded_counter_history(ops(spark, d), -500, 500).select("document_id", "replica_id", "clock", "shown")


@query(f"SELECT document_id, key, CAST(sum(num) AS DOUBLE) AS num FROM ops WHERE {UP} GROUP BY 1, 2")
def counter_map(spark, d):
    return folds.counter_map(ops(spark, d)).select("document_id", "key", *real("num"))


# maps


@query(f"SELECT document_id, key, CAST(num AS DOUBLE) AS num FROM {won('document_id, key')} WHERE op_type = 'upsert'")
def lww_map(spark, d):
    return folds.lww_map(ops(spark, d)).select("document_id", "key", *real("num"))


@query(f"SELECT document_id, key, CAST(num AS DOUBLE) AS num FROM {won('document_id, key', 'ASC')} WHERE op_type = 'upsert'")
def fww_map(spark, d):
    return folds.fww_map(ops(spark, d)).select("document_id", "key", *real("num"))


LIVE = """SELECT DISTINCT document_id, key FROM ops a WHERE op_type = 'upsert' AND NOT EXISTS (SELECT 1 FROM ops r WHERE r.op_type = 'remove' AND r.document_id = a.document_id AND r.key = a.key AND r.replica_id = a.replica_id AND r.clock > a.clock)"""
NEWEST_ADD = "(SELECT document_id, key, num FROM " + won("document_id, key", "DESC", "op_type = 'upsert'") + ")"


@query(f"SELECT document_id, key, CAST(num AS DOUBLE) AS num FROM ({LIVE}) JOIN {NEWEST_ADD} USING (document_id, key)")
def or_map(spark, d):
    o = ops(spark, d)
    return folds.or_map(o, folds.observed_tags(o)).select("document_id", "key", *real("num"))


@query("SELECT document_id, key, CAST(max(num) AS DOUBLE) AS num FROM ops WHERE op_type = 'upsert' GROUP BY 1, 2")
def max_wins_map(spark, d):
    return folds.max_wins_map(ops(spark, d)).select("document_id", "key", *real("num"))


@query("SELECT document_id, key, CAST(min(num) AS DOUBLE) AS num FROM ops WHERE op_type = 'upsert' GROUP BY 1, 2")
def min_wins_map(spark, d):
    return folds.min_wins_map(ops(spark, d)).select("document_id", "key", *real("num"))


# sets


@query("SELECT DISTINCT document_id, key FROM ops WHERE op_type = 'upsert'")
def gset(spark, d):
    return folds.g_set(ops(spark, d)).select("document_id", "key")


@query("SELECT document_id, key FROM (SELECT document_id || '/' || replica_id AS document_id, key, op_type FROM ops) GROUP BY 1, 2 HAVING bool_or(op_type = 'upsert') AND NOT bool_or(op_type = 'remove')")
def two_phase_set(spark, d):
    return folds.two_phase_set(ops(spark, d).withColumn("document_id", F.concat_ws("/", "document_id", "replica_id"))).select("document_id", "key")


LWW_SET = "SELECT document_id, key FROM ops GROUP BY 1, 2 HAVING max(ts) FILTER (WHERE op_type = 'upsert') IS NOT NULL AND (max(ts) FILTER (WHERE op_type = 'remove') IS NULL OR max((ts, replica_id)) FILTER (WHERE op_type = 'upsert') > max((ts, replica_id)) FILTER (WHERE op_type = 'remove'))"


@query(LWW_SET)
def lww_set(spark, d):
    return folds.lww_set(ops(spark, d)).select("document_id", "key")


@query(LWW_SET.replace("max", "min").replace(" > ", " <= "))
def fww_set(spark, d):
    return folds.fww_set(ops(spark, d)).select("document_id", "key")


@query(LIVE)
def or_set(spark, d):
    o = ops(spark, d)
    return folds.or_set(o, folds.observed_tags(o)).select("document_id", "key")


@query(f"SELECT document_id, key, CAST(num AS DOUBLE) AS num, CAST(row_number() OVER (PARTITION BY document_id ORDER BY num, key) AS INT) AS rank FROM ({LWW_SET}) JOIN {NEWEST_ADD} USING (document_id, key)")
def sorted_set(spark, d):
    return folds.sorted_set(ops(spark, d)).select("document_id", "key", *real("num"), "rank")


@query(f"SELECT * FROM (SELECT document_id, key, CAST(num AS DOUBLE) AS num, CAST(row_number() OVER (PARTITION BY document_id ORDER BY num DESC, key) AS INT) AS rank FROM ({LWW_SET}) JOIN {NEWEST_ADD} USING (document_id, key)) WHERE rank <= 10")
def priority_queue_topk(spark, d):
    return folds.priority_queue(ops(spark, d), 10).select("document_id", "key", *real("num"), "rank")


# votes and decorators


@query(f"SELECT document_id, key AS option, count(*) AS votes FROM {won('document_id, replica_id')} GROUP BY 1, 2")
def vote_counter(spark, d):
    return folds.vote_counter(ops(spark, d)).select("document_id", "option", "votes")


@query("""SELECT document_id, key, ts, completed_by FROM (SELECT document_id, key, replica_id AS completed_by, ts, row_number() OVER (PARTITION BY document_id, key ORDER BY arrival, global_clock) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY document_id, key, replica_id ORDER BY arrival, global_clock) AS rn FROM ops) WHERE rn = 1) WHERE n = 3""")
def approval_quorum(spark, d):
    return folds.approval_quorum(ops(spark, d), 3).select("document_id", "key", "ts", "completed_by")


@query("SELECT document_id, CAST(sum(num) AS DOUBLE) AS num FROM ops JOIN (SELECT document_id, max(global_clock // 700) AS e FROM ops GROUP BY 1) USING (document_id) WHERE global_clock // 700 = e AND global_clock % 50 <> 0 AND op_type = 'upsert' GROUP BY 1")
def epoch_bound(spark, d):
    e = F.floor(F.col("global_clock") / 700)
    return folds.epoch_bound(ops(spark, d), e, F.col("global_clock") % 50 == 0, folds.counter).select("document_id", *real("num"))


# graphs and trees


@query("SELECT DISTINCT c_nationkey AS source, n_regionkey AS target FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey", "")
def graph_edges(spark, d):
    nation = table(spark, d, "nation")
    side = lambda name, c: table(spark, d, name).join(nation, F.col(c) == F.col("n_nationkey")).select(F.col(c).alias("source"), F.col("n_regionkey").alias("target"))
    vertices = nation.select(F.col("n_nationkey").alias("vertex"))
    return folds.grow_graph(vertices, side("customer", "c_nationkey").unionByName(side("supplier", "s_nationkey")))[1]


@query("SELECT document_id, key AS edge FROM (SELECT replica_id AS document_id, replica_id || '>' || key AS key, op_type FROM ops) GROUP BY 1, 2 HAVING bool_or(op_type = 'upsert') AND NOT bool_or(op_type = 'remove')")
def two_phase_graph(spark, d):
    o = ops(spark, d)
    edges = o.withColumns({"document_id": F.col("replica_id"), "key": F.concat_ws(">", "replica_id", "key")})
    return folds.two_phase_graph(o, edges)[1].select("document_id", F.col("key").alias("edge"))


@query(f"""SELECT document_id, key AS node, parent FROM ({LIVE}) JOIN (SELECT document_id, key, parent FROM (SELECT document_id, key, CASE WHEN op_type = 'upsert' THEN '0' ELSE str END AS parent, row_number() OVER (PARTITION BY document_id, key ORDER BY ts DESC, replica_id DESC, global_clock DESC) AS rn
  FROM ops WHERE op_type = 'upsert' OR global_clock % 3 = 0) WHERE rn = 1) USING (document_id, key)""")
def replicated_tree(spark, d):
    o = ops(spark, d)
    adds = o.withColumn("str", F.when(folds.upserts(), "0").otherwise(F.col("str")))
    moves = o.filter(folds.removes() & (F.col("global_clock") % 3 == 0))
    return folds.replicated_tree(adds, folds.observed_tags(o), moves).select("document_id", F.col("key").alias("node"), "parent")


@query("""tree AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part WHERE p_partkey >= 1),
 walk AS (SELECT node, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, depth + 1 FROM walk JOIN tree t ON t.parent = walk.node) SELECT node, depth FROM walk""", " ")
def tree_depth_recursive(spark, d):
    tree = table(spark, d, "part").filter("p_partkey >= 1").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return folds.tree_depths(tree)


# sequences


@query("""SELECT document_id, tag, row_number() OVER (PARTITION BY document_id ORDER BY position, tag) AS place FROM (SELECT document_id, tag, CAST(num / 7 AS DECIMAL(18,6)) AS position, replica_id, key, clock FROM ops WHERE op_type = 'upsert') a
  WHERE NOT EXISTS (SELECT 1 FROM ops r WHERE r.op_type = 'remove' AND r.document_id = a.document_id AND r.key = a.key AND r.replica_id = a.replica_id AND r.clock > a.clock)""")
def array_lcs_order(spark, d):
    o = ops(spark, d)
    inserts = o.filter(folds.upserts()).withColumn("position", (F.col("num") / 7).cast("decimal(18,6)"))
    return folds.positional_list(inserts, folds.observed_tags(o), "position").select("document_id", "tag", F.col("place").cast("long").alias("place"))


@query("""SELECT document_id, tag, row_number() OVER (PARTITION BY document_id ORDER BY p, tag) AS place FROM (SELECT document_id, tag, CASE WHEN global_clock % 3 = 0 THEN [CAST(key AS BIGINT)] ELSE [CAST(key AS BIGINT), global_clock % 32] END AS p, replica_id, key, clock FROM ops WHERE op_type = 'upsert') a
  WHERE NOT EXISTS (SELECT 1 FROM ops r WHERE r.op_type = 'remove' AND r.document_id = a.document_id AND r.key = a.key AND r.replica_id = a.replica_id AND r.clock > a.clock)""")
def lseq_order(spark, d):
    o = ops(spark, d)
    first, second = F.col("key").cast("long"), F.col("global_clock") % 32
    inserts = o.filter(folds.upserts()).withColumn("p", F.when(F.col("global_clock") % 3 == 0, F.array(first)).otherwise(F.array(first, second)))
    return folds.positional_list(inserts, folds.observed_tags(o), "p").select("document_id", "tag", F.col("place").cast("long").alias("place"))


@query("""nodes AS (SELECT conv_id, turn + 1 AS id, CASE WHEN turn = 0 THEN NULL ELSE (turn + 1) // 2 END AS left_id, turn % 5 = 4 AS deleted FROM conversations),
 walk AS (SELECT conv_id, id, deleted, [-id] AS p FROM nodes n WHERE left_id IS NULL OR NOT EXISTS (SELECT 1 FROM nodes m WHERE m.conv_id = n.conv_id AND m.id = n.left_id) UNION ALL
  SELECT n.conv_id, n.id, n.deleted, list_append(p, -n.id) FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.left_id = w.id)
 SELECT CAST(conv_id AS VARCHAR) AS conv_id, id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY p) AS INT) AS place, deleted FROM walk""", " ")
def rga_order(spark, d):
    t = F.col("turn")
    nodes = table(spark, d, "conversations").select("conv_id", (t + 1).alias("id"), F.when(t > 0, F.floor((t + 1) / 2)).alias("left_id"), (t % 5 == 4).alias("deleted"))
    return folds.rga_order(nodes, by="conv_id")


def turn_pairs(spark, d) -> DataFrame:
    """Each turn's words beside those of the turn before."""
    words = F.split("text", " ")
    turns = table(spark, d, "conversations").select("conv_id", "turn", words.alias("new"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("new").alias("old"))
    return turns.join(before, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("pair"), "old", "new")


@query()
def lcs_diff(spark, d):
    return diffs.sequence_diff(turn_pairs(spark, d), "pair")


# The SQL fills the table of common lengths a row of old words at a time, over all pairs at once.
@query("""turns AS (SELECT conv_id, turn, coalesce(string_split(text, ' '), []) AS words FROM conversations),
 pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, concat(n.conv_id, '/', n.turn) AS pair, o.words AS old, n.words AS new FROM turns n JOIN turns o ON n.conv_id = o.conv_id AND n.turn = o.turn + 1),
 cells AS MATERIALIZED (SELECT id, unnest(new) AS word, unnest(range(1, len(new) + 1)) AS j FROM pairs),
 lengths AS (SELECT id, 0 AS i, j, 0 AS best FROM cells UNION ALL
  SELECT id, i, j, max(reached) OVER (PARTITION BY id ORDER BY j) FROM (SELECT l.id, l.i + 1 AS i, l.j, greatest(l.best, coalesce(lag(l.best) OVER (PARTITION BY l.id ORDER BY l.j), 0) + CAST(p.old[l.i + 1] = c.word AS INT)) AS reached
   FROM lengths l JOIN pairs p ON p.id = l.id AND l.i < len(p.old) JOIN cells c ON c.id = l.id AND c.j = l.j)),
 whole AS (SELECT p.id, max(best) AS kept FROM pairs p JOIN lengths l ON l.id = p.id AND l.i = len(p.old) GROUP BY 1)
 SELECT pair, CAST(sum(len(old)) AS BIGINT) AS n_old, CAST(sum(len(new)) AS BIGINT) AS n_new, CAST(sum(len(old) - coalesce(kept, 0)) AS BIGINT) AS removed, CAST(sum(len(new) - coalesce(kept, 0)) AS BIGINT) AS added
 FROM pairs LEFT JOIN whole USING (id) GROUP BY 1""", " ")
def lcs_lengths(spark, d):
    """What each turn's diff takes away and adds: no fewer edits would do."""
    pairs = turn_pairs(spark, d)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    edits = lambda kind: F.when(F.col("op_type") == kind, 1).otherwise(0).cast("long")
    sizes = pairs.select("pair", size("old").alias("n_old"), size("new").alias("n_new"), F.lit(0).cast("long").alias("removed"), F.lit(0).cast("long").alias("added"))
    changes = diffs.sequence_diff(pairs, "pair").select("pair", F.lit(0).cast("long").alias("n_old"), F.lit(0).cast("long").alias("n_new"), edits("remove").alias("removed"), edits("upsert").alias("added"))
    return sizes.unionByName(changes).groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("n_old", "n_new", "removed", "added")))


# diffs


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    o = ops(spark, d)
    pick = lambda x: folds.lww_map(x).select("document_id", "key", "num")
    return pick(o.filter("global_clock % 3 <> 0")), pick(o)


KEYS = ["document_id", "key"]
FULL = "(SELECT document_id, key, o.num AS a, n.num AS b, o.key IS NOT NULL AS in_a, n.key IS NOT NULL AS in_b FROM old_map o FULL JOIN new_map n USING (document_id, key))"


@query(f"SELECT document_id, key, CASE WHEN b IS NULL THEN 'remove' ELSE 'upsert' END AS op_type, CAST(b AS DOUBLE) AS num FROM {FULL} WHERE a IS DISTINCT FROM b", MAPS)
def diff_register(spark, d):
    return diffs.register_diff(*snapshots(spark, d), KEYS, "num").select(*KEYS, "op_type", *real("num"))


@query(f"SELECT document_id, key, CAST(coalesce(b, 0) - coalesce(a, 0) AS DOUBLE) AS delta FROM {FULL} WHERE coalesce(b, 0) <> coalesce(a, 0)", MAPS)
def diff_counter(spark, d):
    return diffs.numeric_diff(*snapshots(spark, d), KEYS, "num").select(*KEYS, *real("delta"))


@query(f"SELECT document_id, key, CAST(b AS DOUBLE) AS num FROM {FULL} WHERE b IS NOT NULL AND (a IS NULL OR b > a)", MAPS)
def diff_max_wins(spark, d):
    return diffs.improvement_diff(*snapshots(spark, d), KEYS, "num").select(*KEYS, *real("num"))


@query(f"SELECT document_id, key, CAST(b AS DOUBLE) AS num FROM {FULL} WHERE b IS NOT NULL AND (a IS NULL OR b < a)", MAPS)
def diff_min_wins(spark, d):
    return diffs.improvement_diff(*snapshots(spark, d), KEYS, "num", largest=False).select(*KEYS, *real("num"))


@query(f"SELECT document_id, key, CASE WHEN in_b THEN 'upsert' ELSE 'remove' END AS op_type FROM {FULL} WHERE in_a <> in_b", MAPS)
def diff_set(spark, d):
    return diffs.set_diff(*(x.select(*KEYS) for x in snapshots(spark, d)), KEYS)


MAP_DIFF = f"SELECT document_id, key, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' ELSE 'changed' END AS change, CAST(a AS DOUBLE) AS before, CAST(b AS DOUBLE) AS after FROM {FULL} WHERE in_a <> in_b OR a IS DISTINCT FROM b"


@query(MAP_DIFF, MAPS)
def diff_map(spark, d):
    return diffs.map_diff(*snapshots(spark, d), KEYS, "num").select(*KEYS, "change", *real("before", "after"))


@query(MAP_DIFF, MAPS)
def diff_priority(spark, d):
    return diffs.priority_diff(*snapshots(spark, d), KEYS, "num").select(*KEYS, "change", *real("before", "after"))


@query(f"SELECT n.document_id, n.replica_id, n.key AS option FROM {won('document_id, replica_id')} n LEFT JOIN {won('document_id, replica_id', 'DESC', 'global_clock % 3 <> 0')} o USING (document_id, replica_id) WHERE o.key IS DISTINCT FROM n.key")
def diff_vote(spark, d):
    o = ops(spark, d)
    votes = lambda x: x.groupBy("document_id", "replica_id").agg(F.max(F.struct("ts", "global_clock", "key"))["key"].alias("option"))
    return diffs.vote_diff(votes(o.filter("global_clock % 3 <> 0")), votes(o), ["document_id"], "replica_id", "option")


@query("SELECT o_orderkey AS vertex, CASE WHEN a THEN 'remove' ELSE 'upsert' END AS op_type FROM (SELECT o_orderkey, o_orderkey % 7 <> 0 AS a, o_orderkey % 5 <> 0 AS b FROM orders) WHERE a <> b", "")
def diff_graph(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("vertex"), F.struct(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")).alias("edge"))
    old, new = v.filter("vertex % 7 <> 0"), v.filter("vertex % 5 <> 0")
    return diffs.graph_diff((old.select("vertex"), old.select("edge")), (new.select("vertex"), new.select("edge")), ["vertex"], ["edge"])[0]


@query("""SELECT coalesce(o.node, n.node) AS node, CASE WHEN o.node IS NULL THEN 'added' WHEN n.node IS NULL THEN 'removed' ELSE 'moved' END AS change, o.parent AS before, n.parent AS after FROM
 (SELECT p_partkey AS node, p_partkey // 2 AS parent FROM part WHERE p_partkey % 7 <> 0) o FULL JOIN (SELECT p_partkey AS node, p_partkey // CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS parent FROM part WHERE p_partkey % 5 <> 0) n ON o.node = n.node
 WHERE o.node IS NULL OR n.node IS NULL OR o.parent <> n.parent""", "")
def diff_tree(spark, d):
    p = F.col("p_partkey")
    part = table(spark, d, "part")
    old = part.filter(p % 7 != 0).select(p.alias("node"), F.floor(p / 2).alias("parent"))
    new = part.filter(p % 5 != 0).select(p.alias("node"), F.floor(p / F.when(p % 3 == 0, 3).otherwise(2)).alias("parent"))
    return diffs.tree_diff(old, new)


@query("""SELECT c_custkey, path, CASE WHEN b IS NULL THEN 'remove' ELSE 'upsert' END AS op_type, b AS value FROM (
  SELECT c_custkey, '$.c_name' AS path, c_name AS a, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS b FROM customer UNION ALL
  SELECT c_custkey, '$.c_mktsegment', c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END FROM customer) WHERE a IS DISTINCT FROM b""", "")
def diff_object(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    new = old.select(k, F.when(k % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return diffs.object_diff(old, new, "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT vec_id, i - 1 AS slot FROM (SELECT vec_id, embedding[i] AS a, CASE WHEN i % 4 = 0 THEN embedding[i] + 1 ELSE embedding[i] END AS b, i FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) WHERE a <> b", "")
def diff_fixed_array(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "embedding")
    new = old.select("vec_id", F.transform("embedding", lambda x, i: F.when(i % 4 == 3, x + 1).otherwise(x).cast("float")).alias("embedding"))
    return diffs.slot_diff(old, new, "vec_id", "embedding").select("vec_id", F.col("slot").cast("long").alias("slot"))


@query("""SELECT o_orderkey, a AS "from", b AS "to" FROM (SELECT o_orderkey, o_orderstatus AS a, ['F', 'O', 'P'][o_orderkey % 3 + 1] AS b FROM orders) WHERE a <> b AND (a, b) IN (('O', 'P'), ('P', 'F'))""", "")
def diff_state_machine(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    new = old.select("o_orderkey", F.get(F.array(*map(F.lit, "FOP")), (F.col("o_orderkey") % 3).cast("int")).alias("state"))
    allowed = spark.createDataFrame([("O", "P"), ("P", "F")], "from string, to string")
    return diffs.transition_diff(old, new, ["o_orderkey"], "state", allowed).select("o_orderkey", "from", "to")


@query("SELECT document_id, key, replica_id, row_number() OVER (PARTITION BY replica_id ORDER BY document_id, key) + c AS clock, row_number() OVER (PARTITION BY replica_id ORDER BY document_id, key) + g AS global_clock FROM (SELECT DISTINCT document_id, key, replica_id FROM ops) JOIN (SELECT replica_id, max(clock) AS c, max(global_clock) AS g FROM ops GROUP BY 1) USING (replica_id)")
def clock_assignment(spark, d):
    o = ops(spark, d)
    base = o.groupBy("replica_id").agg(F.max("clock").alias("clock"), F.max("global_clock").alias("global_clock"))
    return diffs.clocked(o.select("document_id", "key", "replica_id").distinct(), base, ["document_id", "key"])


@query("SELECT document_id, global_clock, CAST((num + coalesce(lag(num) OVER (PARTITION BY document_id ORDER BY num, global_clock), num - 2)) / 2 AS DOUBLE) AS between_ FROM ops")
def midpoint_positions(spark, d):
    items = ops(spark, d).select("document_id", "global_clock", F.col("num").alias("position"), "num")
    return diffs.positions_between(items, ["document_id"], ["num", "global_clock"]).select("document_id", "global_clock", F.col("between").cast("double").alias("between_"))


# version vectors and sync


def vectors(spark, d) -> DataFrame:
    o = ops(spark, d).select(F.col("replica_id").alias("origin"), "clock", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("h"))
    seen = o.filter((F.col("clock") <= 3 * (F.col("h") + 1)) | (F.col("clock") % (F.col("h") + 2) == 0)).withColumn("replica_id", F.concat(F.lit("h"), F.col("h").cast("string")))
    return sync.dotted_vector(seen, ["replica_id", "origin"], "clock")


@query("SELECT replica_id, max(clock) AS contiguous FROM ops GROUP BY 1")
def version_vector(spark, d):
    return sync.dotted_vector(ops(spark, d), ["replica_id"], "clock").select("replica_id", "contiguous")


@query("SELECT replica_id, origin, contiguous, list_aggregate(dots, 'string_agg', ',') AS dots FROM vectors", VECTORS)
def dotted_version_vector(spark, d):
    text = F.when(F.size("dots") > 0, F.array_join(F.col("dots").cast("array<string>"), ","))
    return vectors(spark, d).select("replica_id", "origin", "contiguous", text.alias("dots"))


PAIR = "(SELECT s.origin, s.contiguous AS s, coalesce(t.contiguous, 0) AS t, s.dots AS s_dots, coalesce(t.dots, []) AS t_dots FROM (SELECT * FROM vectors WHERE replica_id = 'h2') s LEFT JOIN (SELECT * FROM vectors WHERE replica_id = 'h0') t USING (origin))"
NEEDS = f"(SELECT origin, t, s, list_filter(t_dots, lambda d: d > t AND d <= s) AS known, list_filter(s_dots, lambda d: NOT (d <= t OR list_contains(t_dots, d))) AS missing FROM {PAIR})"


def requirement(spark, d) -> DataFrame:
    v = vectors(spark, d)
    side = lambda h: v.filter(F.col("replica_id") == h).select("origin", "contiguous", "dots")
    return sync.requirements(side("h0"), side("h2"))


@query(f"SELECT origin, t AS target_contiguous, s AS source_contiguous, CAST(len(known) AS INT) AS n_known, CAST(len(missing) AS INT) AS n_missing FROM {NEEDS} WHERE s > t OR len(missing) > 0", VECTORS)
def sync_requirement(spark, d):
    return requirement(spark, d).select("origin", "target_contiguous", "source_contiguous", F.size("known").alias("n_known"), F.size("missing").alias("n_missing"))


BACK = NEEDS.replace("'h2'", "'h9'").replace("'h0'", "'h2'").replace("'h9'", "'h0'")


@query(f"SELECT 'a' AS needs, origin, CAST(len(missing) AS INT) AS n_missing FROM {NEEDS} WHERE s > t OR len(missing) > 0 UNION ALL SELECT 'b', origin, CAST(len(missing) AS INT) FROM {BACK} WHERE s > t OR len(missing) > 0", VECTORS)
def sync_bidirectional(spark, d):
    v = vectors(spark, d)
    side = lambda h: v.filter(F.col("replica_id") == h).select("origin", "contiguous", "dots")
    return sync.bidirectional(side("h0"), side("h2")).select("needs", "origin", F.size("missing").alias("n_missing"))


MISSING = f"(SELECT o.* FROM ops o JOIN {NEEDS} n ON n.origin = o.replica_id WHERE (o.clock > t AND o.clock <= s AND NOT list_contains(known, o.clock)) OR list_contains(missing, o.clock))"


def journal(spark, d) -> DataFrame:
    """A journal whose global clock is the per-origin counter."""
    return ops(spark, d).withColumn("global_clock", F.col("clock"))


@query(f"SELECT replica_id, clock FROM {MISSING}", VECTORS)
def missing_operations(spark, d):
    return sync.missing_operations(requirement(spark, d), journal(spark, d)).select("replica_id", "clock")


@query(f"""SELECT origin, required, required - coalesce(have, 0) AS lacking, required > coalesce(have, 0) AS snapshot_required FROM (SELECT origin, greatest(s - t, 0) - len(known) + len(missing) AS required FROM {NEEDS} WHERE s > t OR len(missing) > 0)
 LEFT JOIN (SELECT replica_id AS origin, count(DISTINCT clock) AS have FROM {MISSING} WHERE clock % 11 <> 0 GROUP BY 1) USING (origin)""", VECTORS)
def journal_completeness(spark, d):
    return sync.journal_completeness(requirement(spark, d), journal(spark, d).filter("clock % 11 <> 0"))


@query("SELECT origin, min(contiguous) AS version FROM vectors GROUP BY 1 HAVING count(DISTINCT replica_id) = 3 AND min(contiguous) > 0", VECTORS)
def gmvv(spark, d):
    return sync.global_minimum(vectors(spark, d), 3)


@query("SELECT origin, contiguous, string_agg(DISTINCT d, ',' ORDER BY d) AS dots FROM (SELECT origin, max(contiguous) AS contiguous FROM vectors GROUP BY 1) LEFT JOIN (SELECT origin, unnest(dots) AS d FROM vectors) x USING (origin) WHERE d > contiguous GROUP BY 1, 2 UNION ALL SELECT origin, max(contiguous), NULL FROM vectors GROUP BY 1 HAVING max(contiguous) >= coalesce(max(list_max(dots)), 0)", VECTORS)
def gmaxvv(spark, d):
    text = F.when(F.size("dots") > 0, F.array_join(F.col("dots").cast("array<string>"), ","))
    return sync.global_maximum(vectors(spark, d)).select("origin", "contiguous", text.alias("dots"))


@query(", u AS (SELECT origin, clock, row_number() OVER (PARTITION BY origin ORDER BY clock) AS rn FROM (SELECT DISTINCT origin, clock FROM seen)) SELECT origin, coalesce(max(clock) FILTER (WHERE clock = rn), 0) AS contiguous, count(*) FILTER (WHERE clock <> rn) AS n_dots FROM u GROUP BY 1", VECTORS)
def dvv_merge(spark, d):
    return sync.merged(vectors(spark, d), ["origin"]).select("origin", "contiguous", F.size("dots").cast("long").alias("n_dots"))


@query("SELECT replica_id, origin, contiguous FROM vectors WHERE replica_id <> 'h1' AND origin NOT IN ('1', '2', '3')", VECTORS)
def evict_replica(spark, d):
    return sync.evicted(vectors(spark, d), ["h1", "1", "2", "3"]).select("replica_id", "origin", "contiguous")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN clock <= 5 THEN 'obsolete' WHEN row_number() OVER (PARTITION BY document_id, replica_id, clock ORDER BY arrival, global_clock) > 1 THEN 'duplicate' ELSE 'new' END AS status
 FROM (SELECT * FROM ops UNION ALL SELECT * FROM ops WHERE global_clock % 6 = 0)) GROUP BY 1""")
def delivery_status(spark, d):
    o = ops(spark, d)
    held = o.select(F.col("replica_id").alias("origin")).distinct().withColumn("contiguous", F.lit(5))
    return sync.delivery_status(o.unionByName(o.filter("global_clock % 6 = 0")), held).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# retention

HALF = "(SELECT CAST(floor((min(ts) + max(ts)) / 2) AS BIGINT) FROM ops)"


def midway(o: DataFrame) -> int:
    r = o.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return ((r["a"] or 0) + (r["b"] or 0)) // 2


STATE = "SELECT document_id, key, max(ts) FILTER (WHERE op_type = 'upsert') AS added, max(ts) FILTER (WHERE op_type = 'remove') AS gone FROM ops GROUP BY 1, 2"


@query(f"SELECT document_id, key, added, gone FROM ({STATE}) WHERE NOT coalesce(gone IS NOT NULL AND (added IS NULL OR gone >= added) AND gone <= {HALF} AND (added IS NULL OR added <= {HALF}), false)")
def compact_ttl(spark, d):
    o = ops(spark, d)
    return retention.compact_lww_set(o, midway(o)).select("document_id", "key", "added", "gone")


@query(f"SELECT document_id, key, added IS NOT NULL AS added, gone FROM ({STATE}) WHERE gone IS NULL OR gone > {HALF}")
def compact_two_phase_set(spark, d):
    o = ops(spark, d)
    return retention.compact_two_phase_set(o, midway(o)).select("document_id", "key", "added", "gone")


#: Add tags; the newest remove of the same replica after the add has seen it, and is safe if every holder has that remove.
REMOVED_TAGS = """(SELECT a.document_id, a.key, a.tag, coalesce(last > a.clock, false) AS removed, coalesce(last <= version, false) AS safe, newest.num FROM ops a
 LEFT JOIN (SELECT document_id, key, replica_id, max(clock) AS last FROM ops WHERE op_type = 'remove' GROUP BY 1, 2, 3) USING (document_id, key, replica_id)
 LEFT JOIN (SELECT origin AS replica_id, min(contiguous) AS version FROM vectors GROUP BY 1 HAVING count(DISTINCT vectors.replica_id) = 3 AND min(contiguous) > 0) USING (replica_id)
 JOIN (SELECT document_id, key, arg_max(num, (ts, replica_id, global_clock)) AS num FROM ops WHERE op_type = 'upsert' GROUP BY 1, 2) newest USING (document_id, key) WHERE a.op_type = 'upsert')"""


@query(f"SELECT document_id, key, tag, removed FROM {REMOVED_TAGS} WHERE NOT (removed AND safe)", VECTORS)
def compact_gmvv_or_set(spark, d):
    o = ops(spark, d)
    return retention.compact_or_set(o, folds.observed_tags(o), sync.global_minimum(vectors(spark, d), 3)).select("document_id", "key", "tag", "removed")


@query(f"SELECT document_id, key, ts, op_type FROM {won('document_id, key')} WHERE NOT (op_type = 'remove' AND ts <= {HALF})")
def compact_lww_map(spark, d):
    o = ops(spark, d)
    return retention.compact_lww_map(o, midway(o)).select("document_id", "key", "ts", "op_type")


@query(f"SELECT document_id, replica_id, max(ts) AS ts FROM ops GROUP BY 1, 2 HAVING bool_or(global_clock % 2 = 0) OR max(ts) > {HALF}")
def compact_votes(spark, d):
    o = ops(spark, d)
    return retention.compact_votes(o, o.filter("global_clock % 2 = 0"), midway(o)).select("document_id", "replica_id", "ts")


@query("""nodes AS (SELECT conv_id, turn + 1 AS id, CASE WHEN turn > 0 THEN turn END AS left_id, turn % 3 <> 0 AS deleted FROM conversations),
 kept AS (SELECT conv_id, max(id) FILTER (WHERE NOT deleted) AS top FROM nodes GROUP BY 1) SELECT CAST(conv_id AS BIGINT) AS conv_id, id FROM nodes JOIN kept USING (conv_id) WHERE id <= top""", " ")
def compact_rga_leaves(spark, d):
    t = F.col("turn")
    nodes = table(spark, d, "conversations").select("conv_id", (t + 1).alias("id"), F.when(t > 0, t).alias("left_id"), (t % 3 != 0).alias("deleted"), F.lit(True).alias("safe"))
    return retention.compact_rga(nodes, by="conv_id").select("conv_id", "id")


@query("SELECT replica_id, global_clock FROM ops LEFT JOIN (SELECT origin AS replica_id, min(contiguous) AS version FROM vectors GROUP BY 1 HAVING count(DISTINCT vectors.replica_id) = 3 AND min(contiguous) > 0) USING (replica_id) WHERE version IS NULL OR clock > version", VECTORS)
def journal_trim(spark, d):
    low = sync.global_minimum(vectors(spark, d), 3)
    o = ops(spark, d).withColumnsRenamed({"global_clock": "event", "clock": "global_clock"})
    return oplog.trimmed(o, low).select("replica_id", F.col("event").alias("global_clock"))


# journal


@query("SELECT replica_id, global_clock, key FROM ops WHERE replica_id = '7' AND global_clock > 100 AND global_clock <= 5000")
def journal_range_scan(spark, d):
    """One origin's range, from a journal on disk: one folder is read."""
    folder = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    oplog.append(ops(spark, d), folder)
    return oplog.in_range(oplog.read_journal(spark, folder), "7", 100, 5000).select("replica_id", "global_clock", "key")


@query("SELECT replica_id, global_clock, key FROM ops WHERE global_clock % 97 = 0")
def journal_point_scan(spark, d):
    """Operations named one by one, from a journal on disk: the folders of their origins are read."""
    folder = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    o = ops(spark, d)
    oplog.append(o, folder)
    dots = saved(o.filter("global_clock % 97 = 0").select("replica_id", "global_clock"))
    return oplog.at_dots(oplog.scanned(spark, folder), dots).select("replica_id", "global_clock", "key")


@query("SELECT replica_id, count(*) AS n, CAST(sum(num) AS DOUBLE) AS num FROM ops GROUP BY 1")
def journal_round_trip(spark, d):
    """Appended twice in part and read back: redeliveries are gone."""
    folder = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    o = ops(spark, d)
    oplog.append(o, folder)
    oplog.append(o.filter("global_clock % 10 = 0"), folder)
    return oplog.read_journal(spark, folder).groupBy("replica_id").agg(F.count(F.lit(1)).alias("n"), F.sum("num").cast("double").alias("num"))


@query("SELECT document_id, count(*) AS n, CAST(sum(num) AS DOUBLE) AS num FROM ops GROUP BY 1")
def json_journal(spark, d):
    folder = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    o = ops(spark, d)
    oplog.write_json_journal(o.unionByName(o.filter("global_clock % 10 = 0")), folder)
    return oplog.read_json_journal(spark, folder).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("num").cast("double").alias("num"))


@query("SELECT tag AS op_id, key, CAST(num AS DOUBLE) AS num FROM ops")
def serializer_round_trip(spark, d):
    return oplog.from_json(oplog.to_json(ops(spark, d))).select("op_id", "key", *real("num"))


# paths


@query("SELECT event_id, json_extract_string(props, '$.k') AS last_segment, 3 AS n_segments FROM events", "")
def path_segments(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("$.props[0]['"), F.get_json_object("props", "$.k"), F.lit("']")).alias("path"))
    return e.select("event_id", F.element_at(paths.segments(F.col("path")), -1).alias("last_segment"), F.size(paths.segments(F.col("path"))).alias("n_segments"))


@query("SELECT c_custkey, c_name || '!' AS name, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS second, c_nationkey + 1 AS nation, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'x' END AS old, c_nationkey * 2 AS made FROM customer", "")
def path_get_set(spark, d):
    """Values at paths through structs, arrays and maps, read and replaced; a map's key is converted, and a missing parent
    is made where that is asked for."""
    k = F.col("c_custkey")
    kind = T.StructType([T.StructField("owner", T.StructType([T.StructField("name", T.StringType()), T.StructField("balance", T.DoubleType())])), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("codes", T.MapType(T.IntegerType(), T.IntegerType())), T.StructField("deep", T.StructType([T.StructField("twice", T.IntegerType())]))])
    nothing = F.lit(None).cast(kind["deep"].dataType)
    tags = F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    codes = F.when(k % 5 == 0, F.create_map(F.lit(1), F.lit(1))).otherwise(F.create_map(F.lit(1), F.lit(1), F.lit(9), F.lit(9)))
    doc = F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("owner"), tags.alias("tags"), codes.alias("codes"), nothing.alias("deep"))
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", doc.alias("doc"))
    at = lambda path: paths.value_at(F.col("doc"), path)
    for path, value in (("$.owner.name", F.concat(at("$.owner.name"), F.lit("!"))), ("$.tags[1]", F.col("c_mktsegment")), ("$.codes['1']", F.col("c_nationkey") + 1), ("$.deep.twice", (F.col("c_nationkey") * 2).cast("int"))):
        rows = rows.withColumn("doc", paths.with_value(F.col("doc"), path, value, kind, create=True))
    return rows.select("c_custkey", at("$.owner.name").alias("name"), at("$.owner.balance").alias("balance"), at("$.tags[1]").alias("second"), F.col("doc.codes")[1].alias("nation"), F.when(F.col("doc.codes")[9].isNotNull(), "x").alias("old"), at("$.deep.twice").alias("made"))


# partitions

RANGES = """counted AS (SELECT o_orderstatus AS grp, o_custkey AS k, count(*) AS n FROM orders GROUP BY 1, 2),
 placed AS (SELECT *, (sum(n) OVER (PARTITION BY grp ORDER BY k) - n) // 400 AS p FROM counted),
 parts AS (SELECT grp, p, min(k) AS start_key, CAST(sum(n) AS BIGINT) AS n_rows FROM placed GROUP BY 1, 2),
 ranges AS (SELECT grp, CAST(row_number() OVER w - 1 AS INT) AS part, start_key, n_rows, lead(start_key) OVER w AS end_key FROM parts WINDOW w AS (PARTITION BY grp ORDER BY start_key))"""


def order_rows(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("grp"), F.col("o_custkey").alias("k"))


@query("SELECT grp, part, start_key, n_rows, end_key FROM ranges", RANGES)
def partition_catalog(spark, d):
    return partitions.catalog(order_rows(spark, d), "grp", "k", 400)


@query("SELECT o_orderkey, part FROM orders JOIN ranges ON grp = o_orderstatus AND start_key <= o_custkey AND (end_key IS NULL OR o_custkey < end_key)", RANGES)
def partition_route(spark, d):
    rows = order_rows(spark, d)
    return partitions.route(rows, partitions.catalog(rows, "grp", "k", 400), "grp", "k").select("o_orderkey", "part")


@query("SELECT grp, part, start_key FROM ranges WHERE grp = 'O' AND start_key <= 77 AND (end_key IS NULL OR 77 < end_key)", RANGES)
def partition_point_lookup(spark, d):
    return partitions.lookup(partitions.catalog(order_rows(spark, d), "grp", "k", 400), "grp", "O", 77).select("grp", "part", "start_key")


@query("SELECT grp, part, start_key FROM ranges WHERE grp = 'F' AND part = 1", RANGES)
def partition_nth(spark, d):
    return partitions.nth(partitions.catalog(order_rows(spark, d), "grp", "k", 400), "grp", "F", 1).select("grp", "part", "start_key")


@query("SELECT grp, count(*) AS parts FROM ranges GROUP BY 1", RANGES)
def partition_count(spark, d):
    return partitions.catalog(order_rows(spark, d), "grp", "k", 400).groupBy("grp").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT grp, min(s) AS start_key, CAST(sum(m) AS BIGINT) AS n_rows FROM (SELECT grp, (sum(n_rows) OVER (PARTITION BY grp ORDER BY start_key) - n_rows) // 1000 AS p, start_key AS s, n_rows AS m FROM ranges) GROUP BY grp, p", RANGES)
def partition_merge(spark, d):
    return partitions.merge(partitions.catalog(order_rows(spark, d), "grp", "k", 400), "grp", 1000).select("grp", "start_key", "n_rows")


@query("""keys AS (SELECT o_orderstatus AS grp, o_custkey AS k, count(*) AS n FROM orders GROUP BY 1, 2), halves AS (SELECT grp, k, n, row_number() OVER (PARTITION BY grp ORDER BY k) > count(*) OVER (PARTITION BY grp) // 2 AND count(*) OVER (PARTITION BY grp) > 1 AND sum(n) OVER (PARTITION BY grp) > 1000 AS h FROM keys)
 SELECT grp, min(k) AS start_key, CAST(sum(n) AS BIGINT) AS n_rows FROM halves GROUP BY grp, h""", " ")
def partition_split(spark, d):
    rows = order_rows(spark, d)
    return partitions.split(partitions.catalog(rows, "grp", "k", 1 << 40), rows, "grp", "k", 1000).select("grp", "start_key", "n_rows")


# streaming


def streamed(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(d if d.endswith("events.parquet") else f"{d}/events.parquet*")


@query(f"SELECT document_id, key, ts, num FROM (SELECT document_id, key, ts, CAST(num AS DOUBLE) AS num FROM {won('document_id, key')})")
def stream_apply_lww(spark, d):
    """The map of newest writes, kept by a stream, equals the batch's."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = streamed(spark, d).select(F.col("event_type").alias("document_id"), F.get_json_object("props", "$.k").alias("key"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts"), F.col("user_id").cast("string").alias("replica_id"), F.col("event_id").alias("global_clock"), (F.col("value").cast("decimal(18,2)") * F.when(F.col("event_id") % 5 == 0, -1).otherwise(1)).cast("double").alias("num"))
    version = streams.apply_stream(e, f"{folder}/state", f"{folder}/checkpoint", streams.newest_per_key(["document_id", "key"], "ts", "replica_id", "global_clock"))
    return streams.state(spark, f"{folder}/state", version).select("document_id", "key", "ts", "num")


@query(f"SELECT document_id, key, CASE WHEN op_type = 'upsert' THEN CAST(num AS DOUBLE) END AS num FROM {won('document_id, key')}")
def stream_state_lww(spark, d):
    """The newest operation of each cell in Spark's state store, over two batches, a restart, and two more with redelivery."""
    folder = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    o = ops(spark, d).select("document_id", "path", "key", "ts", "replica_id", "global_clock", "op_type", "num", (F.col("arrival") % 3).alias("n"))
    source = lambda: spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for n in range(2):
        o.filter(F.col("n") == n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stateful.run(source(), folder)
    for part in (F.col("n") == 2, F.col("n") == 0):  # what is left, and what was delivered before
        o.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stateful.run(source(), folder)
    return stateful.cells(spark, folder).select("document_id", "key", F.when(folds.upserts(), F.col("num").cast("double")).alias("num"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1", "")
def stream_dedup(spark, d):
    """Redelivered operations count once."""
    folder = f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    e = streamed(spark, d).select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("replica_id"), F.col("event_id").alias("global_clock"), "event_type")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    q = streams.distinct_operations(twice, "at", "365 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# delivery


@query("SELECT coalesce(reason, 'applied') AS reason, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(op_type = 'upsert', false) THEN 'operation type' WHEN NOT coalesce(num > 0, false) THEN 'not positive' WHEN NOT coalesce(CAST(key AS INT) < 90, false) THEN 'key out of range' END AS reason FROM ops) GROUP BY 1")
def rejected_operations(spark, d):
    rules = {"operation type": folds.upserts(), "not positive": F.col("num") > 0, "key out of range": F.col("key").cast("int") < 90}
    return delivery.judged(ops(spark, d), rules).groupBy(F.coalesce("reason", F.lit("applied")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT document_id, global_clock FROM (SELECT document_id, global_clock, '$.k' || key AS p FROM ops) o WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT document_id, '$.k' || key AS p FROM ops WHERE global_clock % 9 = 0) l WHERE l.document_id = o.document_id AND l.p = o.p)")
def orphan_operations(spark, d):
    o = ops(spark, d)
    live = o.filter("global_clock % 9 = 0").select("document_id", F.concat(F.lit("$.k"), "key").alias("path"))
    return delivery.orphans(o.withColumn("path", F.concat(F.lit("$.k"), "key", F.lit(".value"))), live).select("document_id", "global_clock")


@query("SELECT global_clock FROM ops WHERE op_type = 'upsert' AND num > 0")
def applied_operations(spark, d):
    o = ops(spark, d)
    _, rejected = delivery.split_rejected(o, {"type": folds.upserts(), "positive": F.col("num") > 0})
    return delivery.applied(o, rejected).select("global_clock")


@query(f"""SELECT document_id, key, CAST(num AS DOUBLE) AS num FROM {won('document_id, key')} WHERE op_type = 'upsert' UNION ALL
 SELECT d, k, 0.5 FROM (SELECT DISTINCT document_id AS d FROM ops), (SELECT unnest(['1', '7', 'seed']) AS k) WHERE NOT EXISTS (SELECT 1 FROM ops WHERE document_id = d AND key = k)""")
def metadata_seed(spark, d):
    o = ops(spark, d)
    values = o.select("document_id", "path").distinct().select("document_id", "path", F.explode(F.array(F.lit("1"), F.lit("7"), F.lit("seed"))).alias("key"), F.lit("0.5").cast("decimal(18,2)").alias("num"))
    return folds.lww_map(delivery.seeded(o, values)).select("document_id", "key", *real("num"))


@query("SELECT CASE WHEN global_clock % 3 = 0 THEN 'tags' WHEN global_clock % 3 = 1 THEN 'header' ELSE 'comments' END AS target, count(*) AS n FROM ops GROUP BY 1")
def header_routing(spark, d):
    path = F.when(F.col("global_clock") % 3 == 0, "$.tags[0]").when(F.col("global_clock") % 3 == 1, "$.title").otherwise("$.comments['k']")
    return delivery.routed(ops(spark, d).withColumn("path", path), ["tags", "comments"]).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, part, CASE WHEN part = 1 THEN k + 1000000 ELSE k END AS k FROM (SELECT o_orderkey, part, o_custkey AS k FROM orders JOIN ranges ON grp = o_orderstatus AND start_key <= o_custkey AND (end_key IS NULL OR o_custkey < end_key))", RANGES)
def partition_save_load(spark, d):
    """Overwriting one part leaves the others as they are."""
    folder = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    rows = order_rows(spark, d)
    placed = partitions.route(rows, partitions.catalog(rows, "grp", "k", 400), "grp", "k")
    delivery.save_partitions(placed, folder, ["grp", "part"])
    delivery.save_partitions(placed.filter("part = 1").withColumn("k", F.col("k") + 1000000), folder, ["grp", "part"])
    return spark.read.parquet(folder).select("o_orderkey", "part", "k")


@query("""s AS (SELECT o_orderstatus AS grp, o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), n AS (SELECT o_orderstatus AS grp, o_custkey AS k, max(o_totalprice) + 1 AS v FROM orders WHERE o_custkey % 50 = 0 GROUP BY 1, 2),
 placed AS (SELECT grp, k, (sum(c) OVER (PARTITION BY grp ORDER BY k) - c) // 400 AS part FROM (SELECT grp, k, 1 AS c FROM s))
 SELECT grp, k, greatest(s.v, coalesce(n.v, s.v)) AS v FROM s LEFT JOIN n USING (grp, k) JOIN placed p USING (grp, k) WHERE (grp, part) IN (SELECT (p.grp, p.part) FROM n JOIN placed p USING (grp, k))""", " ")
def partition_apply(spark, d):
    state = order_rows(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").groupBy("grp", "k").agg(F.max("o_totalprice").alias("v"))
    ranges = partitions.catalog(state, "grp", "k", 400)
    news = state.filter("k % 50 = 0").withColumn("v", F.col("v") + 1)
    merge = lambda rows: rows.groupBy("grp", "part", "k").agg(F.max("v").alias("v"))
    return delivery.apply_to_partitions(partitions.route(state, ranges, "grp", "k"), news, ranges, "grp", "k", merge).select("grp", "k", "v")


@query("SELECT grp, start_key, CASE WHEN part = 0 THEN 0 ELSE n_rows END AS n_rows FROM ranges WHERE part <> 1", RANGES)
def partition_catalog_dml(spark, d):
    ranges = partitions.catalog(order_rows(spark, d), "grp", "k", 400)
    changed = delivery.catalog_changed(ranges, "grp", upserts=ranges.filter("part = 0").withColumn("n_rows", F.lit(0).cast("long")), deletes=ranges.filter("part = 1"))
    return changed.select("grp", "start_key", "n_rows")


# decorators, models and intents

VOTES = OPS + """, votes AS (SELECT *, row_number() OVER (PARTITION BY document_id, {by} ORDER BY arrival, global_clock) AS n FROM (SELECT *, {epoch} AS epoch FROM ops)),
 run AS (SELECT document_id, {by}, n, ts, replica_id, len([replica_id]) >= {quorum} AS full_, CASE WHEN {quorum} <= 1 THEN [] ELSE [replica_id] END AS who, 0 AS done FROM votes WHERE n = 1 UNION ALL
  SELECT v.document_id, {vby}, v.n, v.ts, v.replica_id, len(list_distinct(list_append(who, v.replica_id))) >= {quorum}, CASE WHEN len(list_distinct(list_append(who, v.replica_id))) >= {quorum} THEN [] ELSE list_distinct(list_append(who, v.replica_id)) END, done + CASE WHEN full_ THEN 1 ELSE 0 END
  FROM run r JOIN votes v ON v.document_id = r.document_id AND {on} AND v.n = r.n + 1)"""


@query("SELECT document_id, key, CAST(done AS INT) AS round, ts, replica_id AS completed_by FROM run WHERE full_", VOTES.format(by="key", vby="v.key", on="v.key = r.key", epoch="0", quorum=3))
def quorum_rounds(spark, d):
    """A proposal can pass again: votes are forgotten when its quorum is complete."""
    return folds.quorum_rounds(ops(spark, d), 3, ("key",)).select("document_id", "key", "round", "ts", F.col("replica_id").alias("completed_by"))


@query("SELECT document_id, CAST(sum(num) AS DOUBLE) AS num FROM run JOIN (SELECT document_id, max(epoch) AS newest FROM run WHERE full_ GROUP BY 1) USING (document_id) WHERE full_ AND epoch = newest GROUP BY 1", VOTES.format(by="epoch, num", vby="v.epoch, v.num", on="v.epoch = r.epoch AND v.num = r.num", epoch="global_clock // 2500", quorum=2).replace("FROM ops))", "FROM (SELECT * REPLACE (CAST(key AS DECIMAL(18,2)) AS num) FROM ops)))"))
def model_chained_decorators(spark, d):
    """A counter that only counts what two replicas agreed on, and only in the newest epoch."""
    schema = T.StructType([T.StructField("balance", T.DecimalType(18, 2))])
    model = Model(schema).property("$.balance", "counter").decorate("$.balance", "epoch_bound").decorate("$.balance", "approval_quorum", quorum=2)
    o = ops(spark, d).withColumns({"path": F.lit("$.balance"), "epoch": F.floor(F.col("global_clock") / 2500), "num": F.col("key").cast("decimal(18,2)"), "key": F.lit(None).cast("string"), "str": F.lit(None).cast("string"), "op_type": F.lit("upsert")})
    return model.apply(o)["$.balance"].select("document_id", *real("num"))


@query(f"""SELECT 'title' AS field, document_id, NULL AS key, CASE WHEN op_type = 'upsert' THEN CAST(num AS DOUBLE) END AS num FROM {won('document_id', 'DESC', 'global_clock % 2 = 0')} UNION ALL
 SELECT 'tags', document_id, key, CAST(num AS DOUBLE) FROM {won('document_id, key', 'DESC', 'global_clock % 2 = 1')} WHERE op_type = 'upsert'""")
def model_defaults(spark, d):
    """Fields that no spec names follow their type, and a path below a map names the entry."""
    model = Model(T.StructType([T.StructField("title", T.DecimalType(18, 2)), T.StructField("tags", T.MapType(T.StringType(), T.DecimalType(18, 2)))]))
    below = F.concat(F.lit("$.tags['"), "key", F.lit("']"))
    o = ops(spark, d).withColumn("path", F.when(F.col("global_clock") % 2 == 0, "$.title").otherwise(below)).withColumn("key", F.lit(None).cast("string"))
    states = model.apply(o)
    title = states["$.title"].select(F.lit("title").alias("field"), "document_id", F.lit(None).cast("string").alias("key"), *real("num"))
    return title.unionByName(states["$.tags"].select(F.lit("tags").alias("field"), "document_id", "key", *real("num")))


@query(f"""SELECT 'scores' AS field, document_id, key, CAST(sum(num) AS DOUBLE) AS num FROM ops WHERE global_clock % 3 = 0 GROUP BY document_id, key UNION ALL
 SELECT 'tags', document_id, key, NULL FROM ({LWW_SET.replace('FROM ops', 'FROM ops WHERE global_clock % 3 = 1')}) UNION ALL
 SELECT 'title', document_id, NULL, CAST(num AS DOUBLE) FROM {won('document_id', 'DESC', 'global_clock % 3 = 2')}""")
def intent_round_trip(spark, d):
    """Intents become a log, and the model folds it."""
    schema = T.StructType([T.StructField("scores", T.MapType(T.StringType(), T.DecimalType(18, 2))), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("title", T.DecimalType(18, 2))])
    model = Model(schema).property("$.scores", "counter_map").property("$.tags", "lww_set")
    third = F.col("global_clock") % 3
    pick = lambda a, b, c: F.when(third == 0, a).when(third == 1, b).otherwise(c)
    none = F.lit(None).cast("string")
    given = ops(spark, d).select("document_id", pick(F.lit("$.scores"), F.lit("$.tags"), F.lit("$.title")).alias("path"), pick(F.lit("map_increment"), F.when(folds.upserts(), "add").otherwise("remove_value"), F.lit("set")).alias("intent"), pick(F.col("key"), F.col("key"), none).alias("key"), pick(F.col("num").cast("string"), none, none).alias("num"), pick(none, none, F.col("num").cast("string")).alias("value"), "replica_id", "ts", "clock", "global_clock")
    states = model.apply(intents.logged(given))
    part = lambda name, key, num: states[f"$.{name}"].select(F.lit(name).alias("field"), "document_id", key.alias("key"), num.cast("double").alias("num"))
    return part("scores", F.col("key"), F.col("num")).unionByName(part("tags", F.col("key"), F.lit(None))).unionByName(part("title", none, F.col("num")))


@query("SELECT document_id, lower(k) AS key FROM (SELECT *, CASE WHEN global_clock % 2 = 0 THEN 'KEY' ELSE 'Key' END || key AS k FROM ops) GROUP BY 1, 2 HAVING max((ts, replica_id)) FILTER (WHERE op_type = 'upsert') IS NOT NULL AND (max(ts) FILTER (WHERE op_type = 'remove') IS NULL OR max((ts, replica_id)) FILTER (WHERE op_type = 'upsert') > max((ts, replica_id)) FILTER (WHERE op_type = 'remove'))")
def case_insensitive_set(spark, d):
    """Elements that a comparer holds equal are one element."""
    model = Model(T.StructType([T.StructField("state", T.ArrayType(T.StringType()))])).property("$.state", "lww_set", comparer=F.lower)
    o = ops(spark, d).withColumn("key", F.concat(F.when(F.col("global_clock") % 2 == 0, "KEY").otherwise("Key"), "key"))
    return model.apply(o)["$.state"].select("document_id", "key")


@query("SELECT document_id, CAST(sum(num) AS DOUBLE) AS num, count(*) AS applied FROM ops WHERE op_type = 'upsert' AND num > 0 GROUP BY 1")
def pipeline_decorators(spark, d):
    """Steps before, around and after an application: rejects go, redeliveries go, and the state says what was applied."""
    flow = delivery.Pipeline()
    flow.before.append(lambda rows: delivery.split_rejected(rows, {"type": folds.upserts(), "positive": F.col("num") > 0})[0])
    flow.around.append(lambda apply, rows: apply(rows.dropDuplicates(["op_id"])))
    flow.after.append(lambda rows, state: state.join(rows.dropDuplicates(["op_id"]).groupBy("document_id").agg(F.count(F.lit(1)).alias("applied")), "document_id"))
    o = ops(spark, d)
    return flow.run(o.unionByName(o.filter("global_clock % 6 = 0")), folds.counter).select("document_id", *real("num"), "applied")


@query("SELECT global_clock, key AS vertex, CAST(num AS DOUBLE) AS weight FROM ops WHERE global_clock % 2 = 0")
def payload_kinds(spark, d):
    """Payloads of a registered type, tagged with their kind, through JSON and back."""
    oplog.register_payload("weighted", T.StructType([T.StructField("vertex", T.StringType()), T.StructField("weight", T.DecimalType(18, 2))]))
    o = ops(spark, d)
    rows = oplog.tagged(o.filter("global_clock % 2 = 0"), "weighted", F.struct(F.col("key").alias("vertex"), F.col("num").alias("weight"))).unionByName(o.filter("global_clock % 2 = 1"))
    back = oplog.from_json(oplog.to_json(rows)).withColumn("p", oplog.payload_of("weighted"))
    return back.filter("p IS NOT NULL").select("global_clock", "p.vertex", F.col("p.weight").cast("double").alias("weight"))


@query("""SELECT document_id, count(*) AS n, count(DISTINCT key) AS keys, count(DISTINCT replica_id) AS replicas, CAST(sum(num) AS DOUBLE) AS num, max(ts) AS ts FROM (SELECT 'd' || (i * 31 % 5) AS document_id, CAST(i * 7919 % 100 AS VARCHAR) AS key,
 i * 104729 % 1000 AS num, i * 1000 + i * 6151 % 997 AS ts, 'r' || (i * 613 % 50) AS replica_id FROM (SELECT row_number() OVER () AS i FROM events)) GROUP BY 1""", "")
def generated_log(spark, d):
    """A synthetic log as long as the table of events."""
    return oplog.generated(spark, table(spark, d, "events").count()).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"), F.countDistinct("replica_id").alias("replicas"), F.sum("num").cast("double").alias("num"), F.max("ts").alias("ts"))


# streams of vectors, catch-up and receivers


def journal_stream(spark, d, name: str) -> tuple[str, DataFrame]:
    """A folder, and the journal in it as a stream."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    journal(spark, d).write.parquet(f"{folder}/journal")
    return folder, spark.readStream.schema(oplog.SCHEMA).parquet(f"{folder}/journal")


@query(f"SELECT replica_id, clock FROM {MISSING}", VECTORS)
def stream_catch_up(spark, d):
    """Ranges without the dots that are known already, and the missing dots."""
    folder, rows = journal_stream(spark, d, "catch-up")
    required = saved(requirement(spark, d))
    streams.catch_up(rows, required).select("replica_id", "clock").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("replica_id string, clock long").parquet(f"{folder}/out")


@query("SELECT replica_id, coalesce(max(clock) FILTER (WHERE clock = rn), 0) AS contiguous, count(*) FILTER (WHERE clock <> rn) AS n_dots FROM (SELECT replica_id, clock, row_number() OVER (PARTITION BY replica_id ORDER BY clock) AS rn FROM ops WHERE clock <= 4 OR clock % 3 = 0) GROUP BY 1")
def stream_version_dots(spark, d):
    """What arrives out of order waits as dots in the stream's state."""
    folder, rows = journal_stream(spark, d, "vectors")
    seen = streams.version_dots(rows.filter("clock <= 4 OR clock % 3 = 0"))
    version = streams.apply_stream(seen, f"{folder}/state", f"{folder}/checkpoint", streams.newest_vectors, ["replica_id"])
    return streams.state(spark, f"{folder}/state", version, buckets=True).select("replica_id", "contiguous", F.size("dots").cast("long").alias("n_dots"))


@query("SELECT 'a' AS receiver, document_id, count(*) AS n FROM ops GROUP BY 2 UNION ALL SELECT 'b', document_id, count(*) FROM ops WHERE document_id < 'm' GROUP BY 2")
def stream_fan_out(spark, d):
    folder, rows = journal_stream(spark, d, "fan-out")
    streams.fan_out(rows, f"{folder}/out", f"{folder}/checkpoint", {"a": F.lit(True), "b": F.col("document_id") < "m"})
    read = lambda name: spark.read.parquet(f"{folder}/out/{name}").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("receiver"), "document_id", "n")
    return read("a").unionByName(read("b"))


# more compaction


FIRST = "SELECT document_id, key, min(ts) FILTER (WHERE op_type = 'upsert') AS added, min(ts) FILTER (WHERE op_type = 'remove') AS gone FROM ops GROUP BY 1, 2"


@query(f"SELECT document_id, key, added, gone FROM ({FIRST}) WHERE NOT coalesce(gone IS NOT NULL AND (added IS NULL OR gone < added) AND gone <= {HALF} AND (added IS NULL OR added <= {HALF}), false)")
def compact_fww_set(spark, d):
    o = ops(spark, d)
    return retention.compact_fww_set(o, midway(o)).select("document_id", "key", "added", "gone")


@query(f"SELECT document_id, key, ts, op_type FROM {won('document_id, key', 'ASC')} WHERE NOT (op_type = 'remove' AND ts <= {HALF})")
def compact_fww_map(spark, d):
    o = ops(spark, d)
    return retention.compact_fww_map(o, midway(o)).select("document_id", "key", "ts", "op_type")


FIRSTS = "SELECT document_id, min(ts) AS ts FROM ops WHERE op_type = 'upsert' GROUP BY 1"


@query(f"SELECT document_id, ts FROM ({FIRSTS}) WHERE ts > (SELECT CAST(floor((min(ts) + max(ts)) / 2) AS BIGINT) FROM ({FIRSTS}))")
def compact_fww_register(spark, d):
    o = ops(spark, d)
    firsts = o.filter(folds.upserts()).groupBy("document_id").agg(F.min("ts").alias("ts"))
    return retention.compact_fww_register(o, midway(firsts)).select("document_id", "ts")


@query(f"SELECT document_id, key, tag, removed, CAST(num AS DOUBLE) AS num FROM {REMOVED_TAGS} WHERE NOT (removed AND safe)", VECTORS)
def compact_or_map(spark, d):
    o = ops(spark, d)
    return retention.compact_or_map(o, folds.observed_tags(o), sync.global_minimum(vectors(spark, d), 3)).select("document_id", "key", "tag", "removed", *real("num"))


@query(f"SELECT document_id, key AS node, count(*) AS tags FROM {REMOVED_TAGS} WHERE NOT (removed AND safe) GROUP BY 1, 2", VECTORS)
def compact_tree(spark, d):
    o = ops(spark, d)
    return retention.compact_tree(o, folds.observed_tags(o), sync.global_minimum(vectors(spark, d), 3)).groupBy("document_id", F.col("key").alias("node")).agg(F.count(F.lit(1)).alias("tags"))


@query(f"SELECT document_id, kind, key, added IS NOT NULL AS added, gone FROM (SELECT document_id, kind, key, max(ts) FILTER (WHERE op_type = 'upsert') AS added, max(ts) FILTER (WHERE op_type = 'remove') AS gone FROM (SELECT *, CASE WHEN global_clock % 3 = 0 THEN 'edge' ELSE 'vertex' END AS kind FROM ops) GROUP BY 1, 2, 3) WHERE gone IS NULL OR gone > {HALF}")
def compact_two_phase_graph(spark, d):
    o = ops(spark, d).withColumns({"kind": F.when(F.col("global_clock") % 3 == 0, "edge").otherwise("vertex"), "str": F.lit(None).cast("string")})
    return retention.compact_two_phase_graph(o, midway(o)).select("document_id", "kind", "key", "added", "gone")


@query(f"""SELECT 'tags' AS field, document_id, key, count(*) AS rows_ FROM (SELECT document_id, key FROM ({STATE.replace('FROM ops', 'FROM (SELECT * FROM ops WHERE global_clock % 2 = 0) ops')}) WHERE gone IS NULL OR gone > {HALF}) GROUP BY 2, 3 UNION ALL
 SELECT 'balance', document_id, NULL, count(*) FROM ops WHERE global_clock % 2 = 1 GROUP BY 2""")
def compact_model(spark, d):
    """A model's compaction: each field by its strategy's rule, and those without one keep everything."""
    model = Model(T.StructType([T.StructField("balance", T.DecimalType(18, 2)), T.StructField("tags", T.ArrayType(T.StringType()))])).property("$.balance", "counter").property("$.tags", "two_phase_set")
    o = ops(spark, d).withColumn("path", F.when(F.col("global_clock") % 2 == 0, "$.tags").otherwise("$.balance"))
    states = retention.compact_model(model, o, midway(o))
    tags = states["$.tags"].groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("rows_")).select(F.lit("tags").alias("field"), "document_id", "key", "rows_")
    return tags.unionByName(states["$.balance"].groupBy("document_id").agg(F.count(F.lit(1)).alias("rows_")).select(F.lit("balance").alias("field"), "document_id", F.lit(None).cast("string").alias("key"), "rows_"))


# nested diffs, pointers and the life of partitions


@query("""SELECT c_custkey, path, CASE WHEN b IS NULL THEN 'remove' ELSE 'upsert' END AS op_type, b AS value FROM (
  SELECT c_custkey, '$.name' AS path, c_name AS a, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS b FROM customer UNION ALL
  SELECT c_custkey, '$.address', '{}', CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '{}' END FROM customer UNION ALL
  SELECT c_custkey, '$.address.segment', c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END FROM customer WHERE c_custkey % 5 <> 0 UNION ALL
  SELECT c_custkey, '$.address.place.nation', CAST(c_nationkey AS VARCHAR), CAST(c_nationkey + 1 AS VARCHAR) FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 UNION ALL
  SELECT c_custkey, '$.address.place', '{}', NULL FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0) WHERE a IS DISTINCT FROM b""", "")
def diff_nested_object(spark, d):
    """A parent that is gone is one remove, whatever was in it."""
    k = F.col("c_custkey")
    old = table(spark, d, "customer").select(k, F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")).alias("address"))
    place = F.when(k % 7 != 0, F.struct((F.col("address.place.nation") + 1).alias("nation")))
    new = old.select(k, F.when(k % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), F.when(k % 5 != 0, F.struct(F.when(k % 4 != 0, F.col("address.segment")).alias("segment"), place.alias("place"))).alias("address"))
    return diffs.object_diff(old, new, "c_custkey", ["name", "address"])


@query("SELECT source, target, CASE WHEN a THEN 'remove' ELSE 'upsert' END AS op_type FROM (SELECT DISTINCT o_orderkey AS source, o_custkey AS target, o_orderkey % 7 <> 0 AS a, o_orderkey % 5 <> 0 AS b FROM orders) WHERE a <> b", "")
def diff_graph_edges(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    old, new = e.filter("source % 7 <> 0"), e.filter("source % 5 <> 0")
    vertices = lambda x: x.select(F.col("source").alias("vertex"))
    return diffs.graph_diff((vertices(old), old), (vertices(new), new), ["vertex"], ["source", "target"])[1]


@query("SELECT conv_id, id, lag(id) OVER (PARTITION BY conv_id ORDER BY id) AS left_id FROM (SELECT conv_id, turn + 1 AS id FROM conversations)", "")
def rga_left_pointers(spark, d):
    return diffs.predecessors(table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("id")), ["conv_id"], "id")


@query("""keys AS (SELECT o_orderstatus AS grp, o_custkey AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS nth, sum(count(*)) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS upto FROM orders GROUP BY 1, 2),
 cut AS (SELECT grp, 0::BIGINT AS a, max(nth) AS b, 0::HUGEINT AS low, max(upto) AS high FROM keys GROUP BY 1 UNION ALL
  SELECT grp, CASE WHEN side = 0 THEN a ELSE mid END, CASE WHEN side = 0 THEN mid ELSE b END, CASE WHEN side = 0 THEN low ELSE between_ END, CASE WHEN side = 0 THEN between_ ELSE high END
  FROM (SELECT c.*, k.upto AS between_, k.nth AS mid FROM cut c JOIN keys k ON k.grp = c.grp AND k.nth = a + (b - a) // 2 WHERE high - low > 300 AND b - a > 1), (SELECT unnest([0, 1]) AS side))
 SELECT c.grp, k.k AS start_key, CAST(high - low AS BIGINT) AS n_rows FROM cut c JOIN keys k ON k.grp = c.grp AND k.nth = a + 1 WHERE NOT (high - low > 300 AND b - a > 1)""", " ")
def partition_split_recursive(spark, d):
    """Halves are cut again until no part is too large."""
    rows = order_rows(spark, d)
    return partitions.split(partitions.catalog(rows, "grp", "k", 1 << 40), rows, "grp", "k", 300, again=True).select("grp", "start_key", "n_rows")


#: Strategies whose collections are cut into parts; of an operation on the n-th, its clock is n modulo their number.
PARTED = ["g_set", "two_phase_set", "lww_set", "fww_set", "or_set", "sorted_set", "lww_map", "fww_map", "or_map", "counter_map", "max_wins_map", "min_wins_map", "vote_counter", "array_lcs", "lseq", "rga"]
HEX_CLOCK = "'8' || lpad(printf('%x', {0}), 15, '0')"
DIGITS = "lpad(split_part(CAST(CAST(abs(num) AS DECIMAL(38,10)) AS VARCHAR), '.', 1), 28, '0') || '.' || split_part(CAST(CAST(abs(num) AS DECIMAL(38,10)) AS VARCHAR), '.', 2)"


@query(f"""SELECT global_clock, CASE global_clock % 16 WHEN 12 THEN str WHEN 13 THEN CASE WHEN num < 0 THEN '0' || translate({DIGITS}, '0123456789', '9876543210') ELSE '1' || {DIGITS} END || chr(0) || tag
  WHEN 14 THEN {HEX_CLOCK.format('CAST(key AS BIGINT)')} || replica_id || chr(0) WHEN 15 THEN {HEX_CLOCK.format('global_clock')} || replica_id ELSE key END AS part_key FROM ops WHERE op_type = 'upsert' OR global_clock % 16 < 13""")
def partition_keys(spark, d):
    """What an operation is dealt by, for every strategy whose collections are cut into parts: the element, the key in
    payload or path, the voter, and keys whose text has the order of the list."""
    n = F.col("global_clock") % 16
    o = ops(spark, d).filter(folds.upserts() | (n < 13))
    path = F.get(F.array(*(F.lit(f"$.{s}") for s in PARTED)), n.cast("int"))
    maps = (n >= 6) & (n < 12)
    place = F.array(F.struct(F.col("key").cast("long").alias("position"), F.col("replica_id").alias("replica")))
    o = o.withColumns({"path": F.when(maps, F.concat(path, F.lit("['"), "key", F.lit("']"))).otherwise(path), "pos": F.when(n == 14, keys.of_path(place))}).withColumn("key", F.when(~maps, F.col("key")))
    out = None
    for strategy in PARTED:
        part = partitions.keyed(o, f"$.{strategy}", strategy).select("global_clock", "part_key")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT grp, label, o_orderkey, part, k FROM (SELECT o_orderkey, part, grp, o_custkey AS k FROM orders JOIN ranges ON grp = o_orderstatus AND start_key <= o_custkey AND (end_key IS NULL OR o_custkey < end_key)) RIGHT JOIN (SELECT unnest(['F', 'O', 'P', 'X']) AS grp, unnest(['done', 'open', 'pending', 'none']) AS label) USING (grp)", RANGES)
def partition_full_read(spark, d):
    """The header beside every row of its parts, as they were saved."""
    folder = f"{shared_folder(spark)}/whole-{uuid.uuid4().hex}"
    rows = order_rows(spark, d)
    delivery.save_partitions(partitions.route(rows, partitions.catalog(rows, "grp", "k", 400), "grp", "k"), folder, ["grp", "part"])
    header = spark.createDataFrame([("F", "done"), ("O", "open"), ("P", "pending"), ("X", "none")], "grp string, label string")
    return partitions.reassembled(header, spark.read.parquet(folder), "grp").select("grp", "label", "o_orderkey", "part", "k")


@query(f"SELECT document_id, key, added IS NOT NULL AS added, gone FROM ({STATE}) WHERE gone IS NULL OR gone > {HALF}")
def partition_compact_all(spark, d):
    """A compaction rule over every part of a saved table, in place."""
    folder = f"{shared_folder(spark)}/compact-{uuid.uuid4().hex}"
    o = ops(spark, d)
    threshold = midway(o)
    state = o.groupBy("document_id", "key").agg(F.bool_or(folds.upserts()).alias("added"), F.max(F.when(folds.removes(), F.col("ts"))).alias("gone")).withColumn("part", F.col("key").cast("int") % 4)
    delivery.save_partitions(state, folder, ["document_id", "part"])
    return partitions.compact_all(folder, spark, ["document_id", "part"], lambda rows: rows.filter(F.col("gone").isNull() | (F.col("gone") > threshold))).select("document_id", "key", "added", "gone")


# all strategies of one key in one pass


@query("""SELECT 'balance' AS field, document_id, NULL AS key, CAST(sum(num) AS DOUBLE) AS num FROM ops WHERE global_clock % 2 = 0 AND op_type = 'upsert' GROUP BY document_id UNION ALL
 SELECT 'tags', document_id, key, CAST(max(num) AS DOUBLE) FROM ops WHERE global_clock % 2 = 1 AND op_type = 'upsert' GROUP BY document_id, key""")
def model_apply(spark, d):
    """A document model with a strategy per field, applied to one log."""
    schema = T.StructType([T.StructField("balance", T.DecimalType(18, 2)), T.StructField("tags", T.MapType(T.StringType(), T.DecimalType(18, 2)))])
    model = Model(schema).property("$.balance", "counter").property("$.tags", "max_wins_map")
    o = ops(spark, d).withColumn("path", F.when(F.col("global_clock") % 2 == 0, "$.balance").otherwise("$.tags"))
    states = model.apply(o)
    balance = states["$.balance"].select(F.lit("balance").alias("field"), "document_id", F.lit(None).cast("string").alias("key"), *real("num"))
    return balance.unionByName(states["$.tags"].select(F.lit("tags").alias("field"), "document_id", "key", *real("num")))


@query("SELECT document_id, CAST(sum(num) FILTER (WHERE op_type = 'upsert') AS DOUBLE) AS total, CAST(max(num) FILTER (WHERE op_type = 'upsert') AS DOUBLE) AS largest, CAST(min(num) FILTER (WHERE op_type = 'upsert') AS DOUBLE) AS smallest, count(DISTINCT key) FILTER (WHERE op_type = 'upsert') AS elements, count(DISTINCT replica_id) AS replicas FROM ops GROUP BY 1")
def document_summary(spark, d):
    o = ops(spark, d)
    written = F.when(folds.upserts(), F.col("num"))
    return o.groupBy("document_id").agg(F.sum(written).cast("double").alias("total"), F.max(written).cast("double").alias("largest"), F.min(written).cast("double").alias("smallest"), F.countDistinct(F.when(folds.upserts(), F.col("key"))).alias("elements"), F.countDistinct("replica_id").alias("replicas"))


# values of any type, nested documents, resets


def _plain(num: str) -> str:
    """A number as text, without trailing zeros."""
    return rf"regexp_replace(CAST(CAST({num} AS DECIMAL(38,10)) AS VARCHAR), '\.?0+$', '')"


def read_values(rows: DataFrame) -> DataFrame:
    """Tagged values as their kind and their text."""
    return rows.withColumns({"kind": F.col("value")["kind"], "text": values.read(F.col("value"), T.StringType())})


TYPED = f"""typed AS (SELECT *, CASE global_clock % 5 WHEN 0 THEN 's' WHEN 1 THEN 'n' WHEN 2 THEN 'j' WHEN 3 THEN 'd' END AS kind,
  CASE global_clock % 5 WHEN 0 THEN 't' || key WHEN 1 THEN {_plain('num')} WHEN 2 THEN '{{"k":"' || key || '","n":' || global_clock || '}}' WHEN 3 THEN CAST(CAST(DATE '2020-01-01' + CAST(key AS INT) AS DATE) AS VARCHAR) END AS text FROM ops)"""


def newest_text(by: str, where: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts DESC, replica_id DESC, global_clock DESC) AS rn FROM typed WHERE {where}) WHERE rn = 1)"


REGISTER_OF = "CASE global_clock % 3 WHEN 0 THEN '$.title' WHEN 1 THEN '$.owner' ELSE '$.day' END"


@query(f"""SELECT document_id, {REGISTER_OF} AS path, NULL AS key, kind, text FROM {newest_text(f"document_id, {REGISTER_OF}", "op_type = 'upsert'")} UNION ALL
 SELECT document_id, '$.tags', key, kind, text FROM {newest_text("document_id, key", "op_type = 'remove'")} WHERE kind IS NOT NULL OR global_clock % 2 = 0 UNION ALL
 SELECT document_id, '$.most', NULL, kind, text FROM (SELECT document_id, kind, text, row_number() OVER (PARTITION BY document_id ORDER BY kind DESC, CASE WHEN kind = 'n' THEN num END DESC, text DESC) AS rn FROM typed WHERE kind IN ('n', 's')) WHERE rn = 1""", OPS + ", " + TYPED)
def typed_registers(spark, d):
    """Texts, numbers, structs, dates and nulls in registers and maps of one log: setting null removes a register, a map
    keeps a null entry or, by its own intent, loses the key; an extreme compares by type."""
    o, k = ops(spark, d), F.col("key")
    made = [values.text(F.concat(F.lit("t"), k)), values.number(F.col("num")), values.tagged(F.struct(k.alias("k"), F.col("global_clock").alias("n")), T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])), values.tagged(F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")), T.DateType())]
    clock = F.col("global_clock")
    value = F.when(clock % 5 == 0, made[0]).when(clock % 5 == 1, made[1]).when(clock % 5 == 2, made[2]).when(clock % 5 == 3, made[3])
    base = o.select("document_id", "replica_id", "ts", "clock", "global_clock", "key", "op_type", value.alias("value"))
    paths_ = F.when(clock % 3 == 0, "$.title").when(clock % 3 == 1, "$.owner").otherwise("$.day")
    lost = F.col("value").isNull() & (clock % 2 == 1)
    at = lambda when, path, intent, keyed: F.when(when, F.struct(path.alias("path"), intent.alias("intent"), F.lit(keyed).alias("keyed")))
    registers = at(folds.upserts(), paths_, F.lit("set"), False)
    entries = at(folds.removes(), F.lit("$.tags"), F.when(lost, "map_remove").otherwise("map_set"), True)
    extremes = at((clock % 5).isin(0, 1), F.lit("$.most"), F.lit("set"), False)
    given = base.select("document_id", "replica_id", "ts", "clock", "global_clock", "key", "value", F.inline(F.array_compact(F.array(registers, entries, extremes))))
    owner = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("owner", owner), T.StructField("day", T.DateType()), T.StructField("most", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])
    model = Model(schema).property("$.owner", "lww_register").property("$.most", "max_wins")
    log = intents.logged(given.withColumn("key", F.when(F.col("keyed"), F.col("key"))).drop("keyed"))
    return read_values(model.table(log)).select("document_id", "path", "key", "kind", "text")


#: Leaves of the nested document by global clock modulo their number: path, strategy, whether a key is in the path.
LEAVES = [("$.owner.name", "lww_register"), ("$.owner.balance", "counter"), ("$.owner.contact.city", "fww_register"), ("$.owner.contact.best", "max_wins"), ("$.owner.contact.worst", "min_wins"), ("$.mean", "average_register"), ("$.limit", "bounded_counter"), ("$.tags", "or_set"), ("$.stats.seen", "g_set"), ("$.stats.scores", "lww_map"), ("$.stats.totals", "counter_map"), ("$.votes", "vote_counter"), ("$.slots", "fixed_size_array")]
LEAF = f"global_clock % {len(LEAVES)}"
#: Each leaf's value by its strategy's rule, from the rows of its own.
LEAF_SQL = {
    "lww_register": "SELECT document_id, NULL AS key, CASE WHEN op_type = 'upsert' THEN CAST(num AS DOUBLE) END AS num FROM {newest}",
    "counter": "SELECT document_id, NULL, CAST(sum(num) AS DOUBLE) FROM mine WHERE op_type = 'upsert' GROUP BY 1",
    "fww_register": "SELECT document_id, NULL, CASE WHEN op_type = 'upsert' THEN CAST(num AS DOUBLE) END FROM {oldest}",
    "max_wins": "SELECT document_id, NULL, CAST(max(num) AS DOUBLE) FROM mine WHERE op_type = 'upsert' GROUP BY 1",
    "min_wins": "SELECT document_id, NULL, CAST(min(num) AS DOUBLE) FROM mine WHERE op_type = 'upsert' GROUP BY 1",
    "average_register": "SELECT document_id, NULL, round(CAST(sum(num) AS DOUBLE) / count(*), 6) FROM {newest_by_replica} GROUP BY 1",
    "bounded_counter": "SELECT document_id, NULL, greatest(-100, least(100, CAST(sum(num) AS DOUBLE))) FROM mine WHERE op_type = 'upsert' GROUP BY 1",
    "or_set": "SELECT DISTINCT document_id, key, NULL FROM mine a WHERE op_type = 'upsert' AND NOT EXISTS (SELECT 1 FROM mine r WHERE r.op_type = 'remove' AND r.document_id = a.document_id AND r.key = a.key AND r.replica_id = a.replica_id AND r.clock > a.clock)",
    "g_set": "SELECT DISTINCT document_id, key, NULL FROM mine WHERE op_type = 'upsert'",
    "lww_map": "SELECT document_id, key, CAST(num AS DOUBLE) FROM {newest_by_key} WHERE op_type = 'upsert'",
    "counter_map": "SELECT document_id, key, CAST(sum(num) AS DOUBLE) FROM mine WHERE op_type = 'upsert' GROUP BY 1, 2",
    "vote_counter": "SELECT document_id, key, CAST(count(*) AS DOUBLE) FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, str ORDER BY ts DESC, replica_id DESC, global_clock DESC) AS rn FROM mine WHERE op_type = 'upsert') WHERE rn = 1) GROUP BY 1, 2",
    "fixed_size_array": "SELECT document_id, key, CAST(num AS DOUBLE) FROM {newest_by_key_up} WHERE CAST(key AS INT) < 50",
}


def leaf_sql(strategy: str, where: str) -> str:
    """The rule for one strategy over the operations that satisfy a condition."""
    first = lambda by, way="DESC", only="true": f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts {way}, replica_id {way}, global_clock {way}) AS rn FROM mine WHERE {only}) WHERE rn = 1)"
    rule = LEAF_SQL[strategy].format(oldest_by_key=first("document_id, key", "ASC"), newest=first("document_id"), oldest=first("document_id", "ASC"), newest_by_replica=first("document_id, replica_id", "DESC", UP), newest_by_key=first("document_id, key"), newest_by_key_up=first("document_id, key", "DESC", UP))
    return f"(WITH mine AS (SELECT * FROM ops WHERE {where}) {rule})"


def nested_model() -> Model:
    """A document of structs in structs, with a strategy for most leaves; two follow their type."""
    number, text = T.DecimalType(18, 2), T.StringType()
    field = lambda name, kind: T.StructField(name, kind)
    contact = T.StructType([field("city", number), field("best", number), field("worst", number)])
    owner = T.StructType([field("name", number), field("balance", number), field("contact", contact)])
    stats = T.StructType([field("seen", T.ArrayType(text)), field("scores", T.MapType(text, number)), field("totals", T.MapType(text, number))])
    schema = T.StructType([field("owner", owner), field("mean", number), field("limit", number), field("tags", T.ArrayType(text)), field("stats", stats), field("votes", T.MapType(text, text)), field("slots", T.ArrayType(number))])
    model = Model(schema)
    for path, strategy in LEAVES:
        params = {"bounded_counter": {"low": -100, "high": 100}, "fixed_size_array": {"size": 50}}.get(strategy, {})
        if path not in ("$.owner.name", "$.stats.scores"):
            model.property(path, strategy, **params)
    return model


def nested_log(spark, d) -> DataFrame:
    """Operations dealt to the leaves; a map's key is in the path."""
    at = F.col("global_clock") % len(LEAVES)
    path = F.get(F.array(*(F.lit(p) for p, _ in LEAVES)), at.cast("int"))
    entry = F.get(F.array(*(F.lit(s in ("lww_map", "counter_map")) for _, s in LEAVES)), at.cast("int"))
    return ops(spark, d).withColumns({"path": F.when(entry, F.concat(path, F.lit("['"), "key", F.lit("']"))).otherwise(path), "key": F.when(~entry, F.col("key"))})


@query(" UNION ALL ".join(f"SELECT '{p}' AS path, * FROM {leaf_sql(s, f'{LEAF} = {i}')} AS leaf(document_id, key, num)" for i, (p, s) in enumerate(LEAVES)))
def model_nested(spark, d):
    """Structs in structs, a strategy for every leaf, and one pass over the log."""
    return nested_model().table(nested_log(spark, d)).select("path", "document_id", "key", F.round(F.col("value.num").cast("double"), 6).alias("num"))


SINCE = "(SELECT o.* FROM ops o LEFT JOIN (SELECT document_id, global_clock % 3 AS f, max(arrival) AS last FROM ops WHERE global_clock % 41 = 0 GROUP BY 1, 2) l ON l.document_id = o.document_id AND f = o.global_clock % 3 WHERE last IS NULL OR arrival > last)"


@query(f"""SELECT '$.first' AS path, document_id, NULL AS key, CASE WHEN op_type = 'upsert' THEN CAST(num AS DOUBLE) END AS num FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, replica_id, global_clock) AS rn FROM {SINCE} WHERE global_clock % 3 = 0 AND op_type = 'upsert') WHERE rn = 1 UNION ALL
 SELECT '$.members', document_id, key, NULL FROM {SINCE} WHERE global_clock % 3 = 1 GROUP BY document_id, key HAVING min((ts, replica_id)) FILTER (WHERE op_type = 'upsert') IS NOT NULL AND (min(ts) FILTER (WHERE op_type = 'remove') IS NULL OR min((ts, replica_id)) FILTER (WHERE op_type = 'upsert') <= min((ts, replica_id)) FILTER (WHERE op_type = 'remove')) UNION ALL
 SELECT '$.entries', document_id, key, CAST(num AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY ts, replica_id, global_clock) AS rn FROM {SINCE} WHERE global_clock % 3 = 2) WHERE rn = 1 AND op_type = 'upsert'""")
def fww_clear_model(spark, d):
    """First writers win anew after a clear, by intent, through the log and in a model: register, set and map."""
    clock, none = F.col("global_clock"), F.lit(None).cast("string")
    third = clock % 3
    o = ops(spark, d)
    path = F.when(third == 0, "$.first").when(third == 1, "$.members").otherwise("$.entries")
    up = folds.upserts()
    intent = F.when(clock % 41 == 0, "clear").when(third == 0, F.when(up, "set")).when(third == 1, F.when(up, "add").otherwise("remove_value")).otherwise(F.when(up, "map_set").otherwise("map_remove"))
    given = o.select("document_id", "replica_id", "ts", "clock", "global_clock", "arrival", path.alias("path"), intent.alias("intent"), F.when((third != 0) & (clock % 41 != 0), F.col("key")).otherwise(none).alias("key"), F.when(clock % 41 != 0, F.col("num")).alias("value")).filter("intent IS NOT NULL")
    number = T.DecimalType(18, 2)
    schema = T.StructType([T.StructField("first", number), T.StructField("members", T.ArrayType(T.StringType())), T.StructField("entries", T.MapType(T.StringType(), number))])
    model = Model(schema).property("$.first", "fww_register").property("$.members", "fww_set").property("$.entries", "fww_map")
    return model.table(intents.logged(given)).select("path", "document_id", "key", F.col("value.num").cast("double").alias("num"))


# lists: indices and composite ids


#: What each of three replicas does to a conversation's list: replica, clock, intent, index, value.
EDITS = [("a", 1, "remove", 0, None), ("a", 2, "insert", 0, "a0"), ("b", 1, "insert", 0, "b0"), ("b", 2, "insert", 0, "b1"), ("b", 3, "remove", 0, None), ("b", 4, "insert", 1, "b2"), ("b", 5, "add", None, "b3"), ("b", 6, "remove", 1_000_000, None)]


@query("""given AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, count(*) AS n FROM conversations GROUP BY 1),
 lists AS (SELECT document_id, list_concat(['b0', 'b2', 'a0'], list_transform(range(1, n), lambda i: 't' || i), ['b3']) AS by_position, list_concat(['a0', 'b0', 'b2'], list_transform(range(1, n), lambda i: 't' || i), ['b3']) AS after_left FROM given)
 SELECT strategy, document_id, i AS place, CASE strategy WHEN 'rga' THEN after_left[i] ELSE by_position[i] END AS text FROM (SELECT *, unnest(range(1, len(by_position) + 1)) AS i FROM lists), (SELECT unnest(['array_lcs', 'lseq', 'rga']) AS strategy)""", " ")
def list_intents(spark, d):
    """Inserts and removes by index, from two replicas that had the same list: remove(0), insert(0) against insert(0),
    insert(0), remove(0), insert(1), add. An index is a place in the replica's own list, not a position."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("at"))
    typed = turns.select("document_id", F.lit("$.list").alias("path"), F.lit("base").alias("replica_id"), F.lit("add").alias("intent"), F.lit(None).cast("int").alias("index"), F.concat(F.lit("t"), (F.col("at") - 1).cast("string")).alias("value"), F.col("at").cast("long").alias("ts"), F.col("at").cast("long").alias("clock"), F.col("at").cast("long").alias("global_clock"))
    edits = F.array(*(F.struct(F.lit(r).alias("replica_id"), F.lit(c).cast("long").alias("clock"), F.lit(i).alias("intent"), F.lit(x).cast("int").alias("index"), F.lit(v).cast("string").alias("value")) for r, c, i, x, v in EDITS))
    later = turns.select("document_id").distinct().select("document_id", F.lit("$.list").alias("path"), F.inline(edits)).withColumns({"ts": F.col("clock") + 1_000_000, "global_clock": F.col("clock") + 1_000_000})
    lists = {f"$.{s}": s for s in ("array_lcs", "lseq", "rga")}
    each = lambda rows: rows.withColumn("path", F.explode(F.array(*map(F.lit, lists))))
    nothing = oplog.fitted(typed.filter(F.lit(False)).drop("value"))
    base = saved(intents.edited(each(typed), nothing, lists)[0])
    log = saved(base.unionByName(intents.edited(each(later), base, lists)[0]))
    shown = states.listed(states.partial(log.withColumn("strategy", F.substring("path", 3, 20)), states.LISTS))
    return shown.select("strategy", "document_id", "place", F.col("value")["str"].alias("text"))


@query("""nodes AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn + 1 AS gc, r AS replica, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 1 THEN CASE r WHEN 'a' THEN 'b' ELSE 'a' END ELSE r END AS left_replica FROM conversations, (SELECT unnest(['a', 'b']) AS r)),
 dense AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY gc, replica) AS n FROM nodes),
 walk AS (SELECT document_id, gc, replica, [-n] AS p FROM dense d WHERE left_replica IS NULL OR NOT EXISTS (SELECT 1 FROM dense m WHERE m.document_id = d.document_id AND m.gc = d.gc - 1 AND m.replica = d.left_replica) UNION ALL
  SELECT d.document_id, d.gc, d.replica, list_append(p, -d.n) FROM walk w JOIN dense d ON d.document_id = w.document_id AND d.gc = w.gc + 1 AND d.left_replica = w.replica)
 SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY p) AS place, replica || ':' || gc AS text FROM walk""", " ")
def rga_two_replicas(spark, d):
    """Two replicas with equal clocks: every element once, siblings by clock, then replica."""
    turn = F.col("turn")
    other = F.when(F.col("replica_id") == "a", "b").otherwise("a")
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), turn, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("replica_id"))
    left = F.when(turn > 0, keys.of_id(turn, F.when(turn % 3 == 1, other).otherwise(F.col("replica_id"))))
    log = rows.select("document_id", F.lit("$.list").alias("path"), F.lit("upsert").alias("op_type"), "replica_id", (turn + 1).alias("ts"), (turn + 1).alias("clock"), (turn + 1).alias("global_clock"), (turn + 1).alias("arrival"), left.alias("ref"), values.text(F.concat_ws(":", "replica_id", (turn + 1).cast("string"))).alias("value"))
    model = Model(T.StructType([T.StructField("list", T.ArrayType(T.StringType()))])).property("$.list", "rga")
    return model.apply(oplog.fitted(log))["$.list"].select("document_id", "place", F.col("value")["str"].alias("text"))


# states that merge, are compacted and begin anew


#: Rules for every strategy whose state is told by keys and numbers, beside those of the nested document.
LEAF_SQL |= {
    "g_counter": "SELECT document_id, NULL, CAST(sum(num) FILTER (WHERE num > 0 AND op_type = 'upsert') AS DOUBLE) FROM mine GROUP BY 1",
    "two_phase_set": "SELECT document_id, key, NULL FROM mine GROUP BY 1, 2 HAVING bool_or(op_type = 'upsert') AND NOT bool_or(op_type = 'remove')",
    "lww_set": "SELECT document_id, key, NULL FROM mine GROUP BY 1, 2 HAVING max(ts) FILTER (WHERE op_type = 'upsert') IS NOT NULL AND (max(ts) FILTER (WHERE op_type = 'remove') IS NULL OR max((ts, replica_id)) FILTER (WHERE op_type = 'upsert') > max((ts, replica_id)) FILTER (WHERE op_type = 'remove'))",
    "fww_set": "SELECT document_id, key, NULL FROM mine GROUP BY 1, 2 HAVING min(ts) FILTER (WHERE op_type = 'upsert') IS NOT NULL AND (min(ts) FILTER (WHERE op_type = 'remove') IS NULL OR min((ts, replica_id)) FILTER (WHERE op_type = 'upsert') <= min((ts, replica_id)) FILTER (WHERE op_type = 'remove'))",
    "fww_map": "SELECT document_id, key, CAST(num AS DOUBLE) FROM {oldest_by_key} WHERE op_type = 'upsert'",
    "max_wins_map": "SELECT document_id, key, CAST(max(num) AS DOUBLE) FROM mine WHERE op_type = 'upsert' GROUP BY 1, 2",
    "min_wins_map": "SELECT document_id, key, CAST(min(num) AS DOUBLE) FROM mine WHERE op_type = 'upsert' GROUP BY 1, 2",
    "or_map": "SELECT document_id, key, CAST(num AS DOUBLE) FROM {newest_by_key_up} n WHERE EXISTS (SELECT 1 FROM mine a WHERE a.op_type = 'upsert' AND a.document_id = n.document_id AND a.key = n.key AND NOT EXISTS (SELECT 1 FROM mine r WHERE r.op_type = 'remove' AND r.document_id = a.document_id AND r.key = a.key AND r.replica_id = a.replica_id AND r.clock > a.clock))",
}


MERGED = ["lww_register", "fww_register", "max_wins", "min_wins", "counter", "g_counter", "average_register", "g_set", "two_phase_set", "lww_set", "fww_set", "or_set", "lww_map", "fww_map", "or_map", "counter_map", "max_wins_map", "min_wins_map", "vote_counter"]


def every_strategy(where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM {leaf_sql(s, where)} AS leaf(document_id, key, num)" for s in MERGED)


def told(state: DataFrame) -> DataFrame:
    return states.shown(state).select("strategy", "document_id", "key", F.round(F.col("value.num").cast("double"), 6).alias("num"))


@query(every_strategy())
def state_merge(spark, d):
    """What three replicas made of operations that each saw a part of, merged: as if one had seen them all."""
    o = ops(spark, d)
    seen = lambda n: states.partial_of_each(o.filter(F.pmod(F.xxhash64("tag"), F.lit(3)) == n), MERGED)
    return told(states.merged(states.merged(seen(0), seen(1)), seen(2)))


@query(every_strategy())
def compaction_keeps_values(spark, d):
    """States of all strategies after everything that is safe to forget is forgotten show what they showed."""
    o = ops(spark, d)
    known = o.groupBy(F.col("replica_id").alias("origin")).agg(F.floor(F.max("clock") * 0.75).alias("version"))
    return told(states.compacted(states.partial_of_each(o, MERGED), midway(o), known))


@query(every_strategy("NOT (document_id < 'm' AND global_clock % 3 = 0)"))
def metadata_reset(spark, d):
    """Properties that are reset begin anew from what comes later; others go on."""
    o = ops(spark, d)
    before, later = (states.partial_of_each(o.filter(f"global_clock % 3 {how} 0"), MERGED) for how in ("=", "<>"))
    gone = ops(spark, d).filter("document_id < 'm'").select("document_id", "path").distinct()
    return told(states.merged(states.reset(before, gone), later))


@query(f"SELECT document_id, key, CAST(num AS DOUBLE) AS num FROM {won('document_id, key')} WHERE op_type = 'upsert'")
def diff_decorated(spark, d):
    """What turns an epoch-bound map into another snapshot, in the map's current epoch: applied, it gives that snapshot."""
    model = Model(T.StructType([T.StructField("state", T.MapType(T.StringType(), T.DecimalType(18, 2)))])).decorate("$.state", "epoch_bound")
    o = ops(spark, d)
    log = o.filter("global_clock % 3 <> 0").withColumn("epoch", F.floor(F.col("global_clock") / 2500))
    now = model.apply(log)["$.state"].select("document_id", "key", "num")
    wanted = folds.lww_map(o).select("document_id", "key", "num")
    change = diffs.map_diff(now, wanted, KEYS, "num")
    given = change.select(*KEYS, F.lit("$.state").alias("path"), F.when(F.col("change") == "removed", "remove").otherwise("upsert").alias("op_type"), F.col("after").alias("num"), F.lit("differ").alias("replica_id"))
    base = o.agg(F.max("global_clock").alias("end"))
    clocked = diffs.clocked(given, base.select(F.lit("differ").alias("replica_id"), F.lit(0).alias("clock"), F.col("end").alias("global_clock")), KEYS)
    last = midway(o) * 2 + 1  # after all there is
    timed = clocked.withColumns({"ts": F.lit(last) + F.col("clock"), "arrival": F.col("global_clock")})
    news = oplog.fitted(diffs.decorated(timed, log.select("document_id", "path", "epoch")))
    return model.apply(log.unionByName(news))["$.state"].select("document_id", "key", *real("num"))
