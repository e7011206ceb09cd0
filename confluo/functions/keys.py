"""Text whose order by bytes is the order of what it stands for: numbers, ids and paths of ids. Lists are ordered,
ranges are cut and files are pruned by such keys without decoding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a key's whole part; fractions follow, without trailing zeros.
DIGITS = 28


def of_long(x: Column) -> Column:
    """16 hexadecimal digits, negative numbers first."""
    return F.lower(F.lpad(F.hex(x.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def to_long(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))


def of_number(x: Column) -> Column:
    """A decimal: sign, whole digits, fraction; a negative number's digits are complemented."""
    plain = F.abs(x).cast("decimal(38,10)").cast("string")
    digits = F.concat(F.lpad(F.substring_index(plain, ".", 1), DIGITS, "0"), F.lit("."), F.substring_index(plain, ".", -1))
    return F.when(x >= 0, F.concat(F.lit("1"), digits)).when(x < 0, F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210")))


def of_text(x: Column) -> Column:
    """A text that other parts follow: ended by the least character, which is escaped inside."""
    return F.concat(F.replace(F.replace(x, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01")), F.lit("\x00"))


def of_id(time: Column, replica: Column) -> Column:
    """An id of a time and a replica, ordered by time, then by the replica's bytes."""
    return F.concat(of_long(time), replica)


def of_path(segments: Column) -> Column:
    """A path id, an array of (position, replica): by the first segment that differs, a shorter path before a longer one."""
    return F.array_join(F.transform(segments, lambda s: F.concat(of_long(s["position"]), of_text(s["replica"]))), "")


def of_value(value: Column) -> Column:
    """A tagged value: by kind, then as the kind is ordered."""
    return F.concat(value["kind"], F.coalesce(of_number(value["num"]), F.lit("")), F.coalesce(value["str"], F.lit("")))
