"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Each text gives a vector of transformed statistics. For every language and source, every language, and the
whole corpus, the H share of vectors whose covariance has the smallest determinant is sought: from three
deterministic starts (medians with quartile ranges, the moments of all vectors, and those of the vectors near
the medians in every statistic), two concentration steps each; then the start with the smallest determinant
goes on until no group's determinant falls any more. The estimate is made consistent and refined once by
reweighting. Small groups lean on their language, and languages on the corpus: a group's estimate counts by its
vectors, its parent's like LEAN more of them, so it changes by little with each text and there is no least size.
A vector is rejected when its Mahalanobis distance is improbable.

All of it is native expressions and aggregates. Quantiles come from histograms of fixed-width cells,
so they are the same in every run and no group, however large, is gathered; means and covariances
are sums, pre-aggregated where the vectors are. The text is read once; the steps run on saved vectors of a few
numbers, which meet the table of groups by broadcast, or salted where that is counted too large.

Defined results: null, empty and blank texts have no words and fail the base rules; null language and
source form groups of their own; without a text that passes the base rules nothing is an outlier;
repeated rows count as often as they occur; the estimates use only texts that pass the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.hof import SPACE, SPACE_RUN
from confluo.llm.jobs import BROADCAST_IDS, saved

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, SYMBOLS = 50, 50, "#*$%&|<>"
#: Share of vectors in the estimate, vectors that a parent counts for, tail probability of the cut.
H_SHARE, LEAN, TAIL = 0.75, 50, 1e-6
#: Smallest fall of a determinant that is worth another step.
FALL = 1e-3
#: Smallest standard deviation of each statistic that counts as a difference.
FLOORS = {"log_words": 0.5, "word_length": 0.5, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15}
NAMES = tuple(FLOORS)
D = len(NAMES)
#: Cells of a histogram of distances for each factor e, and parts of a key where groups are too many to broadcast.
CELL, SALTS = 64, 64
KEY = ["lang_", "source_"]


def base_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    group = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(n) for c, n in ((lang, "lang_"), (source, "source_"))]
    wordy = lambda line: F.length(F.translate(line, SPACE, "")) > 0
    rows = docs.select(
        F.col(key).alias("doc_id"),
        *group,
        F.array_remove(F.split(t, SPACE_RUN), "").alias("w"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), wordy).alias("lines"),
    )
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    rows = rows.select(
        *(c for c in rows.columns if c not in ("w", "lines")),
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # only texts that repeat a window sort their windows to find which words that covers
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(repeats, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda a, b: F.coalesce(F.get("ordered", a)["h"] == F.get("ordered", b)["h"], F.lit(False))
    again = F.filter(F.transform("ordered", lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    return rows.select(*(c for c in rows.columns if c not in ("windows", "ordered")), covered.cast("long").alias("n_repeat_words"))


def vectors(statistics: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed statistics."""
    words, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    values = (F.log(words.cast("double")), F.col("word_chars") / words, F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words))
    return statistics.withColumns({"base_failed": failed, **dict(zip(NAMES, values))})


def chi_square_cdf(x: float, degrees: int) -> float:
    """Series of the regularised lower gamma function."""
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return low


def quantile_cells(rows: DataFrame, keys: list[str], cell: Column, shares: list[float]) -> DataFrame:
    """The first cell per key up to which at least each share of the rows lies, as cell_0, cell_1, ..."""
    counted = rows.groupBy(*keys, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)
    upto = counted.select(*keys, "cell", F.sum("n").over(whole.orderBy("cell")).alias("upto"), F.sum("n").over(whole).alias("all"))
    return upto.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= s * F.col("all"), F.col("cell"))).alias(f"cell_{i}") for i, s in enumerate(shares)))


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with their group's columns. A group may hold most of the rows, so its key is never dealt whole: groups
    are broadcast if their count allows, and else go to SALTS parts of each key."""
    if groups.count() <= BROADCAST_IDS // 8:
        return rows.join(F.broadcast(groups), keys, how)
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt_"], how).drop("salt_")


def distance() -> Column:
    """Squared Mahalanobis distance from the columns x of a vector, m_i and v_i_k (inverse factor)."""
    parts = [sum((F.col(f"v_{i}_{k}") * (F.col(NAMES[k]) - F.col(f"m_{k}")) for k in range(i + 1)), F.lit(0.0)) for i in range(D)]
    return sum((p * p for p in parts), F.lit(0.0))


MEANS, LOWER = [f"m_{i}" for i in range(D)], [(i, k) for i in range(D) for k in range(i + 1)]
COVARIANCE, INVERSE = [f"c_{i}_{k}" for i, k in LOWER], [f"v_{i}_{k}" for i, k in LOWER]


def moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Per key the number of vectors, their means and ``scale`` times their covariances."""
    x = [F.col(n) for n in NAMES]
    sums = [F.avg(x[i]).alias(f"m_{i}") for i in range(D)] + [F.avg(x[i] * x[k]).alias(f"q_{i}_{k}") for i, k in LOWER]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    return out.select(*keys, "n", *MEANS, *((scale * (F.col(f"q_{i}_{k}") - F.col(f"m_{i}") * F.col(f"m_{k}"))).alias(f"c_{i}_{k}") for i, k in LOWER))


def factored(out: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the covariance's determinant and the inverse of its Cholesky factor; variances are at least the floors'."""
    floor = [x * x for x in FLOORS.values()]
    columns = [*keys, "n", *MEANS, *COVARIANCE]
    out = out.withColumns({f"c_{i}_{i}": F.greatest(F.col(f"c_{i}_{i}"), F.lit(floor[i])) for i in range(D)})
    for k in range(D):  # column by column
        pivot = F.col(f"c_{k}_{k}") - sum((F.col(f"l_{k}_{j}") * F.col(f"l_{k}_{j}") for j in range(k)), F.lit(0.0))
        out = out.withColumn(f"l_{k}_{k}", F.sqrt(F.greatest(pivot, F.lit(floor[k] / 100))))
        below = {f"l_{i}_{k}": (F.col(f"c_{i}_{k}") - sum((F.col(f"l_{i}_{j}") * F.col(f"l_{k}_{j}") for j in range(k)), F.lit(0.0))) / F.col(f"l_{k}_{k}") for i in range(k + 1, D)}
        out = out.withColumns(below) if below else out
    for i in range(D):  # rows of the inverse
        inverse = {f"v_{i}_{k}": (F.lit(1.0) if i == k else -sum((F.col(f"l_{i}_{j}") * F.col(f"v_{j}_{k}") for j in range(k, i)), F.lit(0.0))) / F.col(f"l_{i}_{i}") for k in range(i + 1)}
        out = out.withColumns(inverse)
    determinant = F.lit(1.0)
    for k in range(D):
        determinant = determinant * F.col(f"l_{k}_{k}") * F.col(f"l_{k}_{k}")
    return out.select(*columns, *INVERSE, determinant.alias("determinant"))


def levelled(rows: DataFrame) -> DataFrame:
    """Each vector in its language and source, in its language and in the whole corpus."""
    any_ = F.lit("*")
    level = lambda lang, source: F.struct(lang.alias("lang_"), source.alias("source_"))
    lang, source = (F.col(c) for c in KEY)
    return rows.select(*NAMES, F.inline(F.array(level(lang, source), level(lang, any_), level(any_, any_))))


def started(rows: DataFrame) -> DataFrame:
    """The starts of each group, numbered."""
    parts = F.array(*(F.struct(F.lit(i).alias("j"), F.floor(F.col(n) * (8 / FLOORS[n])).cast("int").alias("cell")) for i, n in enumerate(NAMES)))
    quartiles = quantile_cells(rows.select(*KEY, F.inline(parts)), [*KEY, "j"], F.col("cell"), [0.25, 0.5, 0.75])
    at = lambda i, c: F.max(F.when(F.col("j") == i, c))
    unit = [FLOORS[n] / 8 for n in NAMES]
    spread = [F.greatest(at(i, F.col("cell_2") - F.col("cell_0")) * unit[i] / 1.349, F.lit(FLOORS[n])) for i, n in enumerate(NAMES)]
    middle = saved(quartiles.groupBy(*KEY).agg(*((at(i, F.col("cell_1")) * unit[i] + unit[i] / 2).alias(f"m_{i}") for i in range(D)), *((x * x).alias(f"c_{i}_{i}") for i, x in enumerate(spread))))
    middle = middle.withColumns({"n": F.lit(0).cast("long"), **{f"c_{i}_{k}": F.lit(0.0) for i, k in LOWER if i != k}})
    close = F.lit(True)
    for i, n in enumerate(NAMES):
        close = close & (F.abs(F.col(n) - F.col(f"m_{i}")) <= 2 * F.sqrt(F.col(f"c_{i}_{i}")))
    near = beside(rows, middle.drop("n"), KEY).filter(close).select(*rows.columns)
    each = (middle, moments(rows, KEY, 1.0), moments(near, KEY, 1.0))
    out = None
    for number, start in enumerate(each):
        start = start.select(*KEY, F.lit(number).alias("start"), "n", *MEANS, *COVARIANCE)
        out = start if out is None else out.unionByName(start)
    return saved(factored(out, [*KEY, "start"]))


def concentrated(rows: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """One step: the moments of the H share of each group's vectors that are nearest by the estimate ``now``."""
    consistent = H_SHARE / chi_square_cdf(chi_square_quantile(H_SHARE, D), D + 2)
    cell = F.floor(CELL * F.log(distance() + 1e-6)).cast("int").alias("cell")
    far = beside(rows, now.select(*keys, *MEANS, *INVERSE), KEY).select(*keys, *NAMES, cell)
    cut = saved(quantile_cells(far, keys, F.col("cell"), [H_SHARE]))
    return saved(factored(moments(beside(far, cut, keys).filter("cell <= cell_0"), keys, consistent), keys))


def smallest_determinants(rows: DataFrame) -> DataFrame:
    """Per group the estimate of the smallest determinant that steps from the starts lead to."""
    now, keys = started(rows), [*KEY, "start"]
    for _ in range(2):
        now = concentrated(rows, now, keys)
    best = saved(now.groupBy(*KEY).agg(F.min_by(F.struct("n", *MEANS, *COVARIANCE, *INVERSE, "determinant"), F.struct("determinant", "start")).alias("b")).select(*KEY, "b.*"))
    moving = best
    while True:  # each turn lowers some determinant by FALL at least, and the floors bound it below
        after = concentrated(rows, moving, KEY)
        before = moving.select(*KEY, F.col("determinant").alias("before"))
        moving = saved(after.join(before, KEY).filter(F.col("determinant") < (1 - FALL) * F.col("before")).drop("before"))
        if moving.isEmpty():
            return best
        best = saved(best.join(moving.select(*KEY), KEY, "left_anti").unionByName(moving.select(best.columns)))


def leaning(rows: DataFrame) -> DataFrame:
    """Moments of groups mixed with those of their parents (p_...), which count for LEAN vectors."""
    w = F.col("n") / (F.col("n") + LEAN)
    apart = [F.col(f"m_{i}") - F.col(f"p_m_{i}") for i in range(D)]
    means = [(w * F.col(m) + (1 - w) * F.col(f"p_{m}")).alias(m) for m in MEANS]
    covariances = [(w * F.col(f"c_{i}_{k}") + (1 - w) * F.col(f"p_c_{i}_{k}") + w * (1 - w) * apart[i] * apart[k]).alias(f"c_{i}_{k}") for i, k in LOWER]
    return rows.select(*KEY, "n", *means, *covariances)


def estimates(rows: DataFrame) -> DataFrame:
    """Reweighted MCD location and inverse covariance factor per language and source."""
    rows = saved(levelled(rows.filter(~F.col("base_failed"))))
    best = smallest_determinants(rows)
    inner = chi_square_quantile(0.975, D)
    near = beside(rows, best.select(*KEY, *MEANS, *INVERSE), KEY).filter(distance() <= inner)
    own = saved(moments(near, KEY, 0.975 / chi_square_cdf(inner, D + 2)))
    corpus, everywhere = F.col("lang_") == "*", F.col("source_") == "*"
    whole = own.filter(corpus).first()
    inherited = [(F.lit(whole[c] if whole else None).cast("double")).alias(f"p_{c}") for c in (*MEANS, *COVARIANCE)]
    langs = leaning(own.filter(everywhere & ~corpus).select(*own.columns, *inherited))
    parents = langs.select("lang_", *(F.col(c).alias(f"p_{c}") for c in (*MEANS, *COVARIANCE)))
    return saved(factored(leaning(beside(own.filter(~everywhere), saved(parents), ["lang_"])), KEY)).select(*KEY, *MEANS, *INVERSE)


def judged(docs: DataFrame, **names) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance (squared; null without an estimate) and kept."""
    rows = saved(vectors(base_statistics(docs, **names)))
    cut = chi_square_quantile(1 - TAIL, D)
    out = beside(rows, estimates(rows), KEY, "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
