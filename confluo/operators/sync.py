"""Version vectors, what a replica is missing, and whether the journal can supply it.

A dotted version vector is a table (replica_id, origin, contiguous, dots): all versions up to
``contiguous`` and the single ones in ``dots`` (ascending, all beyond it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions.ordering import in_version

DOTS = "array<bigint>"


def dotted_vector(seen: DataFrame, by: list[str], version: str) -> DataFrame:
    """Versions seen per ``by`` as contiguous prefix and dots, by gaps and islands: the k-th smallest version
    equals k exactly in the prefix."""
    rows = seen.select(*by, F.col(version).alias("v")).distinct()
    w = Window.partitionBy(*by).orderBy("v")
    rows = rows.withColumn("prefix", F.col("v") == F.row_number().over(w))
    return rows.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("prefix"), F.col("v"))), F.lit(0)).cast("long").alias("contiguous"), F.array_sort(F.collect_list(F.when(~F.col("prefix"), F.col("v")))).alias("dots"))


def absorbed(vectors: DataFrame) -> DataFrame:
    """Dots that follow the prefix without a gap become part of it; dots within it go."""
    beyond = F.array_sort(F.array_distinct(F.filter("dots", lambda d: d > F.col("contiguous"))))
    rows = vectors.withColumn("dots", beyond)
    run = F.size(F.filter(F.transform("dots", lambda d, i: d - i == F.col("contiguous") + 1), lambda ok: ok))
    rows = rows.withColumn("upto", F.col("contiguous") + run)
    left = rows.withColumn("dots", F.filter("dots", lambda d: d > F.col("upto")))
    return left.withColumn("contiguous", F.col("upto")).drop("upto")


def merged(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Least upper bound of several vectors per ``by``: largest prefix, union of dots."""
    return absorbed(vectors.groupBy(*by).agg(F.max("contiguous").alias("contiguous"), F.array_distinct(F.flatten(F.collect_list("dots"))).alias("dots")))


def global_maximum(vectors: DataFrame) -> DataFrame:
    """Per origin the largest prefix anywhere and the dots beyond it."""
    top = vectors.groupBy("origin").agg(F.max("contiguous").alias("contiguous"))
    dots = vectors.select("origin", F.explode("dots").alias("d")).distinct()
    beyond = dots.join(top, "origin").filter("d > contiguous").groupBy("origin").agg(F.array_sort(F.collect_list("d")).alias("dots"))
    return top.join(beyond, "origin", "left").select("origin", "contiguous", F.coalesce("dots", F.array().cast(DOTS)).alias("dots"))


def global_minimum(vectors: DataFrame, replicas: int) -> DataFrame:
    """Per origin the version that all of ``replicas`` have; an origin that one lacks, or has at 0, is absent."""
    return vectors.groupBy("origin").agg(F.min("contiguous").alias("version"), F.countDistinct("replica_id").alias("n")).filter((F.col("n") == replicas) & (F.col("version") > 0)).select("origin", "version")


def evicted(vectors: DataFrame, gone: list[str]) -> DataFrame:
    """Vectors without replicas that left, as holders and as origins."""
    return vectors.filter(~F.col("replica_id").isin(gone) & ~F.col("origin").isin(gone))


def requirements(target: DataFrame, source: DataFrame) -> DataFrame:
    """What ``target`` lacks of ``source``, per origin; both are (origin, contiguous, dots). known: versions in
    the missing range that the target holds as dots; missing: the source's dots that it doesn't hold."""
    t = target.select("origin", F.col("contiguous").alias("t"), F.col("dots").alias("t_dots"))
    rows = source.join(t, "origin", "left").withColumns({"t": F.coalesce("t", F.lit(0)).cast("long"), "t_dots": F.coalesce("t_dots", F.array().cast(DOTS))})
    known = F.filter("t_dots", lambda d: (d > F.col("t")) & (d <= F.col("contiguous")))
    missing = F.filter("dots", lambda d: ~in_version(d, F.col("t"), F.col("t_dots")))
    return rows.select("origin", F.col("t").alias("target_contiguous"), F.col("contiguous").alias("source_contiguous"), known.alias("known"), missing.alias("missing")).filter("source_contiguous > target_contiguous OR size(missing) > 0")


def bidirectional(a: DataFrame, b: DataFrame) -> DataFrame:
    """Requirements both ways; ``needs`` names the side that lacks."""
    return requirements(a, b).withColumn("needs", F.lit("a")).unionByName(requirements(b, a).withColumn("needs", F.lit("b")))


def missing_operations(required: DataFrame, journal: DataFrame) -> DataFrame:
    """Journal rows (replica_id, global_clock, ...) that fill the requirements: ranges without the known, and dots.
    Dots are rows of their own, so a journal row meets its dot and not an array of them. The journal may be a stream."""
    ranges = required.select(F.col("origin").alias("replica_id"), "target_contiguous", "source_contiguous")
    dot = lambda name, wanted: F.transform(name, lambda d: F.struct(d.alias("global_clock"), F.lit(wanted).alias("wanted")))
    dots = required.select(F.col("origin").alias("replica_id"), F.inline(F.concat(dot("known", False), dot("missing", True))))
    within = (F.col("global_clock") > F.col("target_contiguous")) & (F.col("global_clock") <= F.col("source_contiguous"))
    return journal.join(ranges, "replica_id").join(dots, ["replica_id", "global_clock"], "left").filter(F.coalesce("wanted", within)).select(journal.columns)


def journal_completeness(required: DataFrame, journal: DataFrame) -> DataFrame:
    """Per origin how many required versions there are and how many the journal lacks; any lack asks for a snapshot.
    Ranges are counted, never listed, so a long absence costs no more than a short one."""
    have = missing_operations(required, journal).select("replica_id", "global_clock").distinct().groupBy(F.col("replica_id").alias("origin")).agg(F.count(F.lit(1)).alias("have"))
    span = F.greatest(F.col("source_contiguous") - F.col("target_contiguous"), F.lit(0)) - F.size("known") + F.size("missing")
    rows = required.select("origin", span.cast("long").alias("required")).join(have, "origin", "left")
    return rows.select("origin", "required", (F.col("required") - F.coalesce("have", F.lit(0))).alias("lacking")).withColumn("snapshot_required", F.col("lacking") > 0)


def delivery_status(ops: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each delivered operation as obsolete (within the vector), duplicate (delivered before) or new."""
    held = vectors.select(F.col("origin").alias("replica_id"), "contiguous")
    again = F.row_number().over(Window.partitionBy("document_id", "replica_id", "clock").orderBy("arrival", "global_clock"))
    rows = ops.join(held, "replica_id", "left").withColumn("again", again)
    status = F.when(F.col("clock") <= F.coalesce("contiguous", F.lit(0)), "obsolete").when(F.col("again") > 1, "duplicate").otherwise("new")
    return rows.withColumn("status", status).drop("again", "contiguous")
