"""Where operations come from and go to: normalised logs, the journal, tagged payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from confluo.functions.ordering import micros, operation_id
from confluo.functions.values import VALUE

#: An operation: who, where, what, when. One wide nullable payload keeps every kind in native columns; ``kind``
#: tells payloads of one strategy apart, and ``epoch`` is what an epoch-bound decorator wraps them in. ``value`` is a
#: payload of any type (``num`` is the short form of a number), ``pos`` a list element's position as an ordered key,
#: and ``ref`` the element that an operation refers to: the one removed, or an insert-after list's left neighbour.
SCHEMA = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("op_type", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("num", T.DecimalType(18, 2)),
        T.StructField("str", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("replica_id", T.StringType()),
        T.StructField("clock", T.LongType()),
        T.StructField("global_clock", T.LongType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("op_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("value", VALUE),
        T.StructField("pos", T.StringType()),
        T.StructField("ref", T.StringType()),
    ]
)
#: Folders of a journal, to which origins are dealt, and the column that tells the folder. Fixed: journals are found by it.
JOURNAL_BUCKETS, BUCKET = 64, "replica_id_bucket"
#: Types of payloads beyond the wide row, by kind.
PAYLOADS: dict[str, T.DataType] = {}


def register_payload(kind: str, type_: T.DataType) -> None:
    """Payloads of this kind are read from and written to JSON with this type."""
    PAYLOADS[kind] = type_


def tagged(rows: DataFrame, kind: str, payload: Column) -> DataFrame:
    """``rows`` with ``kind`` and their payload, of the registered type, as JSON in ``str``."""
    return rows.withColumns({"kind": F.lit(kind), "str": F.to_json(payload.cast(PAYLOADS[kind]))})


def payload_of(kind: str) -> Column:
    """The payload of rows of this kind, null for others."""
    return F.when(F.col("kind") == kind, F.from_json("str", PAYLOADS[kind]))


def fitted(rows: DataFrame) -> DataFrame:
    """Rows in the shape of an operation log; what they lack is null."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA))


def generated(spark: SparkSession, n: int, documents: int = 5, replicas: int = 50, keys: int = 100) -> DataFrame:
    """A synthetic log of ``n`` operations, the same in every run, one in four of them a remove."""
    i = F.col("id")
    rows = spark.range(1, n + 1).select(
        F.concat(F.lit("d"), (i * 31 % documents).cast("string")).alias("document_id"),
        F.lit("$.state").alias("path"),
        F.when(i % 4 == 0, "remove").otherwise("upsert").alias("op_type"),
        (i * 7919 % keys).cast("string").alias("key"),
        (i * 104729 % 1000).cast("decimal(18,2)").alias("num"),
        (i * 1000 + i * 6151 % 997).alias("ts"),
        F.concat(F.lit("r"), (i * 613 % replicas).cast("string")).alias("replica_id"),
        i.alias("global_clock"),
        i.alias("arrival"),
    )
    return fitted(rows.withColumns({"tag": operation_id(), "op_id": operation_id()}))


def from_events(events: DataFrame) -> DataFrame:
    """The events table as an operation log. One event in four removes, one in five counts down, and the
    order of arrival is a fixed shuffle of the order of creation."""
    e = F.col("event_id")
    rows = events.select(
        F.col("event_type").alias("document_id"),
        F.lit("$.state").alias("path"),
        F.when(e % 4 == 0, "remove").otherwise("upsert").alias("op_type"),
        F.get_json_object("props", "$.k").alias("key"),
        (F.col("value").cast("decimal(18,2)") * F.when(e % 5 == 0, -1).otherwise(1)).cast("decimal(18,2)").alias("num"),
        F.concat(F.lit("v"), (e % 1000).cast("string")).alias("str"),
        micros("ts").alias("ts"),
        F.col("user_id").cast("string").alias("replica_id"),
        e.alias("global_clock"),
        (e * 7919 % 1000003).alias("arrival"),
    )
    rows = rows.withColumn("clock", F.row_number().over(Window.partitionBy("replica_id").orderBy("global_clock")).cast("long"))
    return fitted(rows.withColumns({"tag": operation_id(), "op_id": operation_id()}))


def append(ops: DataFrame, journal: str) -> None:
    """Append to the journal: Parquet, partitioned by buckets of origins, so that catch-up reads prune, however many
    origins there are. Within a bucket's files rows are in order of origin and clock."""
    at = [BUCKET, "replica_id", "global_clock"]
    ops.withColumn(BUCKET, bucket(F.col("replica_id"))).hint("rebalance", BUCKET).sortWithinPartitions(*at).write.mode("append").partitionBy(BUCKET).parquet(journal)


def bucket(origin: Column) -> Column:
    return F.pmod(F.xxhash64(origin), F.lit(JOURNAL_BUCKETS)).cast("int")


def read_journal(spark: SparkSession, journal: str) -> DataFrame:
    """The journal without redelivered operations."""
    return scanned(spark, journal).dropDuplicates([BUCKET, "replica_id", "global_clock"])


def scanned(spark: SparkSession, journal: str) -> DataFrame:
    """The journal as it lies, with redeliveries, and the bucket of each operation's origin."""
    return spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(journal)


def in_range(journal: DataFrame, origin: str, above: int, upto: int) -> DataFrame:
    """Operations of one origin with above < global_clock <= upto. Of a journal on disk, one folder is read."""
    rows = journal.filter((F.col("global_clock") > above) & (F.col("global_clock") <= upto) & (F.col("replica_id") == origin))
    return rows.filter(F.col(BUCKET) == bucket(F.lit(origin))).drop(BUCKET) if BUCKET in journal.columns else rows


def at_dots(journal: DataFrame, dots: DataFrame) -> DataFrame:
    """Operations named by (replica_id, global_clock). Of a journal on disk, only the folders of buckets that the dots name are
    read: the dots' origins prune its partitions while the query runs. Clocks begin at 0."""
    wanted = dots.select("replica_id", "global_clock").filter(F.col("global_clock") >= 0).distinct()
    if BUCKET not in journal.columns:
        return journal.join(wanted, ["replica_id", "global_clock"], "left_semi")
    return journal.join(wanted.withColumn(BUCKET, bucket(F.col("replica_id"))), [BUCKET, "replica_id", "global_clock"], "left_semi").drop(BUCKET)


def trimmed(journal: DataFrame, minimum: DataFrame) -> DataFrame:
    """The journal without what every replica has: (origin, version) of the global minimum."""
    low = minimum.select(F.col("origin").alias("replica_id"), "version")
    return journal.join(low, "replica_id", "left").filter(F.col("version").isNull() | (F.col("global_clock") > F.col("version"))).drop("version")


def to_json(ops: DataFrame) -> DataFrame:
    """One JSON document per operation, nulls left out."""
    return ops.select("op_id", F.to_json(F.struct(*ops.columns)).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", SCHEMA).alias("o")).select("o.*")


def write_json_journal(ops: DataFrame, folder: str, compression: str = "gzip") -> None:
    """A journal of compressed JSON lines, for exchange with other programs."""
    ops.write.mode("append").option("compression", compression).json(folder)


def read_json_journal(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON journal with a fixed schema and without redelivered operations."""
    return spark.read.schema(SCHEMA).json(folder).dropDuplicates(["replica_id", "global_clock"])
