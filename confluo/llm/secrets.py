"""Secrets in whole texts: three fixed patterns, and a randomness test battery for strings without one.

Strings of token characters whose alphabet looks like an encoding (hex, base32, letters, mixed alphanumeric,
base64) are tested against the hypothesis that each character is drawn at random from that alphabet:
a chi-squared test of uniformity, a runs test about the middle of the alphabet, and a lag-1 serial
correlation test, combined by Fisher's method into one statistic. Short strings fill few cells of an alphabet
and the three tests depend on each other, so the statistic's p-value isn't taken from a formula: its distribution
under the hypothesis is drawn, per alphabet and length, from NULLS pseudo-random strings that go through the same
expression. Names, counters and paths fail these tests; keys pass them as often as chance lets them. Letters of
one case are tested from LETTERS characters on, as the battery can't tell shorter words from keys.

How small a p-value may still be declared a secret is set by false-discovery control per encoding
and length: the share of truly random strings is estimated from the upper end of the p-values, which
gives, for each cut, the expected share of structured strings among those declared. Short strings
leave the tests little power, so their cut comes out higher. The histogram behind it covers all
documents and has a fixed number of cells; PRIOR strings of a usual mixture are added to each, so that
few strings lean on the usual cut and many decide for themselves.

Everything is a native expression on one row; the only shuffle is that histogram's partial sums.

Defined results: null text counts as empty; an empty text has no spans; spans never overlap within a
kind; strings that touch a base span aren't added; positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm.hof import let, matches, total

#: Kinds in their order, patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LETTERS = 40
#: Whole runs of token characters, with their padding, that hold a digit, a change from lower to upper case, or many
#: letters of one case; tried only where a run begins, so long runs cost their length.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])|(?=[A-Z]*[a-z]+[A-Z])|(?=[a-z]{%d}|[A-Z]{%d}))[A-Za-z0-9+/_-]{20,}={0,2}" % (LETTERS, LETTERS)
#: Encodings: name, pattern of strings that look like it, characters in their order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("UPPER36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", UPPER + DIGITS),
    ("lower36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", LOWER + DIGITS),
    ("mixed62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed52", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", UPPER + LOWER),
    ("lower26", r"^[a-z]{%d,}$" % LETTERS, LOWER),
    ("UPPER26", r"^[A-Z]{%d,}$" % LETTERS, UPPER),
)
#: Lengths from which a class of its own begins; strings drawn per class and alphabet; cells of the p-value histogram.
LENGTHS = (20, 22, 24, 28, 32, 36, 40, 44, 48, 56, 64, 80, 96, 128, 192, 256)
NULLS, CELLS = 1000, 200
#: Share of false discoveries; p-values above are taken for random strings'; strings of the usual mixture, and its cut.
FDR, NULL_FROM, PRIOR, USUAL_CUT = 0.05, 0.8, 100, 0.02


def log_two_sided(z: Column) -> Column:
    """log P(|Z| >= |z|) of a standard normal, by a rational approximation of the complementary error function."""

    def tail(x: Column) -> Column:
        poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.log(F.greatest(let(1 / (1 + 0.3275911 * x), poly), F.lit(1e-300))) - x * x

    return let(F.least(F.abs(z), F.lit(12.0)) / math.sqrt(2), tail)


def codes(text: Column, alphabet: Column) -> Column:
    """Places of a string's characters in its alphabet."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("int"))


def battery(v: Column, k: Column) -> Column:
    """Fisher's statistic of the three tests for an array of codes below ``k``: the larger, the less random."""
    n = F.size(v).cast("double")
    # the sum of squared counts, from the runs of equal codes in order
    begin = F.struct(F.lit(-1).alias("code"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, x: let(F.when(x == a["code"], a["run"] + 1).otherwise(F.lit(1).cast("long")), lambda run: F.struct(x.alias("code"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum")))
    squares = F.aggregate(F.array_sort(v), begin, step)["sum"]
    uniform = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    half = F.floor(k / 2)
    high = F.size(F.filter(v, lambda x: x >= half)).cast("double")
    turns = 1 + F.size(F.filter(F.sequence(F.lit(1), F.size(v) - 1), lambda i: (F.get(v, i) >= half) != (F.get(v, i - 1) >= half)))
    runs = let(2 * high * (n - high), lambda both: F.when(both > n, (turns - both / n - 1) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(12.0))

    def lag(mean: Column) -> Column:
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lagged = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda a, i: a + (F.get(v, i) - mean) * (F.get(v, i - 1) - mean))
        return let(square, lambda s: F.when(s > 0, lagged / s * F.sqrt(n)).otherwise(12.0))

    serial = let(total(F.transform(v, lambda x: x.cast("long"))) / n, lag)
    return F.aggregate(F.array(uniform, runs, serial), F.lit(0.0), lambda a, z: a - log_two_sided(z))


#: What ``null_statistics`` has drawn; it is the same in every session.
_DRAWN: dict[tuple[int, int], list[float]] = {}


def null_statistics(spark: SparkSession) -> dict[tuple[int, int], list[float]]:
    """(alphabet size, length class) -> ascending statistics of random strings, CELLS + 1 quantiles."""
    if not _DRAWN:
        sizes = sorted({len(x[2]) for x in ENCODINGS})
        k, n = F.col("k"), F.col("n")
        classes = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("size"), F.lit(x).alias("n")) for k in sizes for i, x in enumerate(LENGTHS)))
        drawn = spark.range(NULLS).select("id", F.inline(classes))
        random = F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64("id", i, k), k.cast("long")).cast("int"))
        t = drawn.select("k", "size", let(random, lambda v: battery(v, k)).alias("t"))
        levels = F.array(*(F.lit(i / CELLS) for i in range(CELLS + 1)))
        for r in t.groupBy("k", "size").agg(F.percentile("t", levels).alias("q")).collect():
            _DRAWN[r["k"], r["size"]] = list(r["q"])
    return _DRAWN


def candidates(text: Column) -> Column:
    """Array of (start, end, encoding, size, t) of the strings with an inferred encoding; size is the length class."""
    alphabets = F.array(*(F.lit(x[2]) for x in ENCODINGS))

    def inferred(m: Column) -> Column:
        bare = F.rtrim(m["match"], F.lit("="))
        coding = F.lit(None).cast("int")
        for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
            coding = F.when(bare.rlike(pattern), i).otherwise(coding)
        size = sum((F.when(F.length(bare) >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), coding.alias("encoding"), size.alias("size"), bare.alias("match"))

    def tested(c: Column) -> Column:
        t = let(F.get(alphabets, c["encoding"]), lambda a: let(codes(c["match"], a), lambda v: battery(v, F.length(a))))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), c["size"].alias("size"), t.alias("t"))

    return F.transform(F.filter(F.transform(matches(text, CANDIDATE), inferred), lambda c: c["encoding"].isNotNull()), tested)


def p_values(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """One row per candidate: start, end, encoding, size, t, p, by the drawn distribution of its class."""
    spark = docs.sparkSession
    rows = [(i, size, null_statistics(spark)[len(x[2]), size]) for i, x in enumerate(ENCODINGS) for size in range(len(LENGTHS))]
    nulls = spark.createDataFrame(rows, "encoding int, size int, q array<double>")
    found = docs.select(F.inline(candidates(F.coalesce(F.col(text), F.lit("")))))
    above = F.size(F.filter("q", lambda x: x > F.col("t"))) / F.lit(CELLS + 1.0)
    return found.join(F.broadcast(nulls), ["encoding", "size"]).select("start", "end", "encoding", "size", "t", above.alias("p"))


def cuts(docs: DataFrame, *, text: str = "text") -> dict[tuple[int, int], float]:
    """The largest statistic to declare, per (encoding, length class), from all documents' candidates. At
    most encodings x classes x CELLS counts reach the driver."""
    cell = F.least(F.floor(F.col("p") * CELLS), F.lit(CELLS - 1)).cast("int")
    counted = p_values(docs, text=text).groupBy("encoding", "size", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    seen: dict[tuple[int, int], list[int]] = {}
    for r in counted:
        seen.setdefault((r["encoding"], r["size"]), [0] * CELLS)[r["cell"]] = r["n"]
    drawn = null_statistics(docs.sparkSession)
    out = {}
    for (e, size), histogram in seen.items():
        q = drawn[len(ENCODINGS[e][2]), size]
        out[e, size] = q[CELLS - int(round(least_cut(histogram) * CELLS))]
    return out


def usual() -> list[float]:
    """Histogram of the usual mixture: half random strings, half structured ones below the usual cut."""
    low = max(1, int(round(USUAL_CUT * CELLS)))
    return [PRIOR / 2 / CELLS + (PRIOR / 2 / low if cell < low else 0) for cell in range(CELLS)]


def least_cut(histogram: list[int]) -> float:
    """Smallest p-value whose expected share of structured strings above it is at most FDR."""
    mixed = [a + b for a, b in zip(histogram, usual())]
    top = int(NULL_FROM * CELLS)
    random = sum(mixed[top:]) / (1 - NULL_FROM)
    declared = sum(mixed)
    for cell in range(top):
        if 1 - random * (1 - cell / CELLS) / declared <= FDR:
            return max(cell / CELLS, 1 / CELLS)
        declared -= mixed[cell]
    return NULL_FROM


def spans(text: Column, cut: dict[tuple[int, int], float]) -> Column:
    """All spans of a text as (start, order of the kind, end), ascending."""
    value = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    folded = F.lower(text)
    named = _any([folded.contains(x) for x in ("passw", "secret", "token", "api")])
    assign = F.filter(matches(text, ASSIGN, named), lambda m: F.length(F.regexp_replace(m["match"], value, "")) >= 6)
    plain = lambda found, kind: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    base = F.concat(plain(assign, 0), plain(matches(text, ACCESS, text.contains("AKIA")), 1), plain(matches(text, HEX), 2))

    def more(base: Column) -> Column:
        passes = lambda c: _any([(c["encoding"] == e) & (c["size"] == n) & (c["t"] <= t) for (e, n), t in sorted(cut.items())])
        free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        extra = F.filter(candidates(text), lambda c: passes(c) & free(c))
        return F.array_sort(F.concat(base, plain(extra, 3)))

    return let(base, more)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def joined(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", cut: dict | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, n_random, spans."""
    cut = cuts(docs, text=text) if cut is None else cut
    found = docs.select(F.col(key).alias("doc_id"), spans(F.coalesce(F.col(text), F.lit("")), cut).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), count(3).alias("n_random"), joined(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", cut: dict | None = None) -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark. Null texts stay null."""
    cut = cuts(docs, text=text) if cut is None else cut

    def rebuilt(found: Column) -> Column:
        # the furthest end so far decides whether a span starts a new stretch
        empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
        step = lambda a, s: F.struct(F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
        return F.aggregate(found, empty, step, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))))

    return docs.withColumn(text, let(spans(F.col(text), cut), lambda found: F.when(F.size(found) > 0, rebuilt(found)).otherwise(F.col(text))))
