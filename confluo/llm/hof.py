"""Small building blocks for row-local array work in native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as characters and as a pattern.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def starts(lengths: Column, block: int = 128) -> Column:
    """Exclusive prefix sums of an array of longs, in blocks, so that long arrays don't cost their square."""
    zero = F.lit(0)

    def within(sums: Column) -> Column:
        before = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        return let(before, lambda before: F.transform(lengths, lambda _, i: F.get(before, F.floor(i / block).cast("int")) + total(F.slice(lengths, (i - i % block + 1).cast("int"), (i % block).cast("int")))))

    blocks = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, within))


def matches(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, match), in code points. A cheap
    necessary condition may be given as ``possible``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if possible is not None:
        found = F.when(possible, found).otherwise(F.array().cast("array<string>"))

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
        # before match i lie gaps 0..i and matches 0..i-1
        steps = let(gaps, lambda g: F.transform(found, lambda x, i: F.get(g, i) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)))
        begins = let(steps, lambda s: let(starts(s), lambda b: F.transform(s, lambda x, i: F.get(b, i) + x)))
        return let(begins, lambda b: F.transform(found, lambda x, i: F.struct(F.get(b, i).alias("start"), (F.get(b, i) + F.length(x)).alias("end"), x.alias("match"))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(placed(f)))
