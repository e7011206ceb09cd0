"""Large collections in key ranges: a catalog of half-open ranges, routing by as-of lookup, split and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions import keys
from confluo.functions.paths import segments, within
from confluo.operators.folds import upserts
from confluo.operators.joins import beside
from confluo.operators.ranks import summed
from confluo.session import saved

#: Ranges of a catalog that are broadcast at once for routing.
BROADCAST_RANGES = 200_000
#: Parts of a saved table that share a folder, and the column that tells the folder.
PARTS_PER_FOLDER, BLOCK = 1000, "part_block"


def catalog(rows: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """Ranges of about ``size`` rows in key order per ``by``: part, start_key, end_key (null: open), n_rows."""
    counted = summed(rows.groupBy(by, key).agg(F.count(F.lit(1)).alias("n")), [by], [key], "n", "upto_")
    before = F.col("upto_") - F.col("n")
    # a row per range from here on
    parts = counted.withColumn("part", F.floor(before / size).cast("int")).groupBy(by, "part").agg(F.min(key).alias("start_key"), F.sum("n").alias("n_rows"))
    w = Window.partitionBy(by).orderBy("start_key")
    return parts.withColumns({"end_key": F.lead("start_key").over(w), "part": (F.row_number().over(w) - 1).cast("int")})


def route(rows: DataFrame, ranges: DataFrame, by: str, key: str) -> DataFrame:
    """Rows with the part whose range holds their key, null where there is none. The catalog is broadcast in
    blocks of at most BROADCAST_RANGES ranges, each as one sorted array per ``by`` that a row searches by halving;
    the greatest start of all blocks wins. Rows aren't shuffled, whatever a group's size."""
    ranges = saved(ranges)  # it is read once per block, and counted
    blocks = max(1, -(-ranges.count() // BROADCAST_RANGES))
    name = lambda i: f"found_{i}_"
    for i in range(blocks):
        mine = ranges if blocks == 1 else ranges.filter(F.pmod(F.xxhash64(by, "start_key"), F.lit(blocks)) == i)
        starts = mine.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start_key", "part"))).alias("starts_"))
        powers = F.array(*(F.lit(1 << k) for k in reversed(range(BROADCAST_RANGES.bit_length()))))
        no_later = lambda at: F.coalesce(F.get("starts_", at)["start_key"] <= F.col(key), F.lit(False))
        last = F.aggregate(powers, F.lit(-1), lambda at, step: F.when(no_later(at + step), at + step).otherwise(at))
        rows = rows.join(F.broadcast(starts), by, "left").withColumn(name(i), F.when(last >= 0, F.get("starts_", last))).drop("starts_")
    found = F.greatest(*(F.col(name(i)) for i in range(blocks))) if blocks > 1 else F.col(name(0))
    return rows.withColumn("part", found["part"]).drop(*(name(i) for i in range(blocks)))


def lookup(ranges: DataFrame, by: str, value: str, key) -> DataFrame:
    """The range that holds one key."""
    return ranges.filter((F.col(by) == value) & (F.col("start_key") <= F.lit(key)) & (F.col("end_key").isNull() | (F.lit(key) < F.col("end_key"))))


def nth(ranges: DataFrame, by: str, value: str, n: int) -> DataFrame:
    return ranges.filter((F.col(by) == value) & (F.col("part") == n))


def split(ranges: DataFrame, rows: DataFrame, by: str, key: str, most: int, again: bool = False) -> DataFrame:
    """Ranges above ``most`` rows cut at their median key, once or, with ``again``, halves as long as they are too
    large and hold several keys. Only the table of ranges goes from turn to turn."""
    placed = route(rows, ranges, by, key).filter("part IS NOT NULL")
    keys = placed.groupBy(by, "part", key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by, "part").orderBy(key)
    ranked = saved(keys.withColumns({"nth": F.row_number().over(w), "upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))}))
    # a range is (first, last] by rank of its keys, and low and high count rows before and up to them
    now = ranked.groupBy(by, "part").agg(F.max("nth").alias("last"), F.max("upto").alias("high")).select(by, "part", F.lit(0).alias("first"), "last", F.lit(0).cast("long").alias("low"), "high")
    done = None
    while True:
        large = (F.col("high") - F.col("low") > most) & (F.col("last") - F.col("first") > 1)
        kept, todo = now.filter(~large), now.filter(large)
        done = kept if done is None else done.unionByName(kept)
        middle = todo.withColumn("nth", F.col("first") + F.floor((F.col("last") - F.col("first")) / 2).cast("int"))
        cut = middle.join(ranked.select(by, "part", "nth", F.col("upto").alias("between")), [by, "part", "nth"])
        halves = F.array(F.struct(F.col("first"), F.col("nth").alias("last"), F.col("low"), F.col("between").alias("high")), F.struct(F.col("nth").alias("first"), F.col("last"), F.col("between").alias("low"), F.col("high")))
        now = saved(cut.select(by, "part", F.inline(halves)))
        if not again or now.isEmpty():
            done = done.unionByName(now)
            break
    starts = ranked.select(by, "part", F.col("nth").alias("begin"), F.col(key).alias("start_key"))
    parts = done.withColumn("begin", F.col("first") + 1).join(starts, [by, "part", "begin"]).select(by, "start_key", (F.col("high") - F.col("low")).alias("n_rows"))
    order = Window.partitionBy(by).orderBy("start_key")
    return parts.select(by, (F.row_number().over(order) - 1).cast("int").alias("part"), "start_key", "n_rows", F.lead("start_key").over(order).alias("end_key"))


def merge(ranges: DataFrame, by: str, least: int) -> DataFrame:
    """Neighbours joined so that no range but a document's last stays below ``least`` rows."""
    before = F.sum("n_rows").over(Window.partitionBy(by).orderBy("start_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_rows")
    parts = ranges.withColumn("to", F.floor(before / least)).groupBy(by, "to").agg(F.min("start_key").alias("start_key"), F.sum("n_rows").alias("n_rows"))
    order = Window.partitionBy(by).orderBy("start_key")
    return parts.select(by, (F.row_number().over(order) - 1).cast("int").alias("part"), "start_key", "n_rows", F.lead("start_key").over(order).alias("end_key"))


def keyed(ops: DataFrame, root: str, strategy: str) -> DataFrame:
    """Operations of the property at ``root`` with ``part_key``, a text by which they are dealt to parts: the element, the
    map's key (from the payload, else from the path), the voter, or a list element's place in the order of its list. All
    operations on one of these have the same key, and keys of list elements are ordered as the list is. Null for
    operations of the whole property."""
    below = F.when(F.col("path") != root, F.element_at(segments(F.col("path")), -1))
    element = F.when(upserts(), F.col("tag")).otherwise(F.col("ref"))
    key = {
        "vote_counter": F.coalesce("str", "replica_id"),
        "array_lcs": F.concat(keys.of_text(F.coalesce("pos", keys.of_number(F.col("num")))), element),
        "lseq": F.col("pos"),
        "rga": F.when(upserts(), keys.of_id(F.col("global_clock"), F.col("replica_id"))).otherwise(F.col("ref")),
    }.get(strategy, F.coalesce("key", below))
    return ops.filter(within(F.col("path"), root)).withColumn("part_key", key)


def minimum_key(type_: T.DataType):
    """The key that no other of its type is below, from which a property's first range starts."""
    return -(2**63) if isinstance(type_, T.IntegralType) else "" if isinstance(type_, T.StringType) else None


def reassembled(header: DataFrame, data: DataFrame, by: str) -> DataFrame:
    """The whole document again: every row of its parts beside its header, and headers without any data. Rows of the
    parts aren't dealt by their document, of which a few may hold most."""
    header, rest = saved(header), [c for c in data.columns if c != by]
    whole = beside(data.filter(F.col(by).isNotNull()), header, [by], "inner", header.count()).select(*header.columns, *rest)
    bare = header.join(data.select(by).distinct(), by, "left_anti")
    return whole.unionByName(bare, allowMissingColumns=True)


def blocked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the block of parts that share their folder."""
    return rows.withColumn(BLOCK, F.floor(F.col(by[-1]) / PARTS_PER_FOLDER).cast("int"))


def written(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Write the folders of blocks that the rows are in, each from few tasks, in order of parts, so that a reader of one
    part skips the rest of its block."""
    at = [*by[:-1], BLOCK]
    dealt = blocked(rows, by).hint("rebalance", *at).sortWithinPartitions(*at, by[-1])
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*at).parquet(folder)


def compact_all(folder: str, spark, by: list[str], rule) -> DataFrame:
    """Run a compaction rule over every part of a saved table, in place; parts come as they are written, each by
    itself. Returns what is kept."""
    written(saved(rule(spark.read.parquet(folder))), folder, by)
    return spark.read.parquet(folder)
