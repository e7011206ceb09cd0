"""Values of any type in one column: a tag, a number and a text, so that registers and maps of numbers, texts, dates
and structs share one log, compare by type, and stay native columns.

Kinds: b boolean, d date, n number, s text, t timestamp, j anything nested, as JSON. Values of one kind compare as
their type does (JSON as text); of two kinds, by the kind's letter. A null value is a null struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = T.DecimalType(38, 10)
VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("num", NUMBER), T.StructField("str", T.StringType())])
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _made(given: Column, kind: str, num: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None)
    whole = F.struct(F.lit(kind).alias("kind"), (none if num is None else num).cast(NUMBER).alias("num"), (none if text is None else text).cast("string").alias("str"))
    return F.when(given.isNotNull(), whole)


def tagged(value: Column, kind: T.DataType) -> Column:
    """A column of a type as a value. Fractions that a decimal can't hold keep their text."""
    if isinstance(kind, T.StructType) and [f.name for f in kind.fields] == VALUE.fieldNames():
        return value
    if isinstance(kind, T.NullType):
        return F.lit(None).cast(VALUE)
    if isinstance(kind, T.BooleanType):
        return _made(value, "b", value.cast("int"))
    if isinstance(kind, T.DateType):
        return _made(value, "d", F.unix_date(value))
    if isinstance(kind, T.TimestampType):
        return _made(value, "t", F.unix_micros(value))
    if isinstance(kind, T.TimestampNTZType):
        return _made(value, "t", F.timestamp_diff("MICROSECOND", F.expr(EPOCH), value))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _made(value, "n", value.cast("string").try_cast(NUMBER), value.cast("string"))
    if isinstance(kind, T.NumericType):
        return _made(value, "n", value.try_cast(NUMBER))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return _made(value, "j", None, F.to_json(value))
    return _made(value, "s", None, value.cast("string"))


def number(value: Column) -> Column:
    return _made(value, "n", value)


def text(value: Column) -> Column:
    return _made(value, "s", None, value)


def read(value: Column, kind: T.DataType) -> Column:
    """A value as a type, converted where it is of another kind; null where it can't be."""
    num, string, tag = value["num"], value["str"], value["kind"]
    if isinstance(kind, T.BooleanType):
        return F.when(tag == "s", string.try_cast("boolean")).otherwise(num != 0)
    if isinstance(kind, T.DateType):
        return F.when(tag == "d", F.date_from_unix_date(num.cast("int"))).when(tag == "s", string.try_cast("date"))
    if isinstance(kind, T.TimestampType):
        return F.when(tag == "t", F.timestamp_micros(num.cast("long"))).when(tag == "s", string.try_cast("timestamp"))
    if isinstance(kind, T.TimestampNTZType):
        return F.when(tag == "t", F.timestamp_add("MICROSECOND", num.cast("long"), F.expr(EPOCH))).when(tag == "s", string.try_cast("timestamp_ntz"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(string.try_cast(kind), num.try_cast(kind))
    if isinstance(kind, T.NumericType):
        return F.coalesce(num.try_cast(kind), string.try_cast(kind))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(string, kind)
    plain = F.regexp_replace(num.cast("string"), r"\.?0+$", "")
    return F.when(tag == "b", (num != 0).cast("string")).when(tag == "d", F.date_from_unix_date(num.cast("int")).cast("string")).otherwise(F.coalesce(string, plain))


def payload(ops: DataFrame) -> Column:
    """The value that an operation carries: its tagged value, or else its number."""
    plain = number(F.col("num"))
    return F.coalesce(F.col("value"), plain) if "value" in ops.columns else plain
