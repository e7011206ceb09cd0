"""Mixing sources to target weights by balanced sampling, the cube method.

A source's target over its size is how often each of its documents is wanted: a whole number of copies, and a fraction
that becomes an inclusion probability. In the flight, three documents that are still undecided move along the null
space of the two balancing constraints, their number and their words, until one of them is in or out; which way is
drawn so that probabilities are kept. Totals don't change while this goes on. What remains is a small landing problem:
a few documents of every order of size, decided from the largest to the smallest so that the words stay nearest to
the target.

At scale: a source's documents (ids and sizes, no texts) are dealt by a hash to blocks of about BLOCK, each block flies
on its own, from large documents to small ones, and what it leaves (at most three of each order of size) flies again in
far fewer blocks, until a source has one. Hot sources have more blocks, not larger ones. The table of sources is
broadcast only if it is small by count; otherwise it is joined salted.

Defined results: a null text has size 0, and a document of size 0 is taken 0 times its size whatever is drawn. Repeated
rows are documents of their own. A null source is a source, the last one. Draws are hashes of the document's id, size
and source, so runs agree; of equal rows, any may be taken, which gives the same rows. A source without words has
target 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.jobs import BROADCAST_IDS, saved
from confluo.operators.ranks import ranked

#: Weights of the sources in order, repeating, and how often a source may be used at most.
WEIGHTS, MOST = (1, 2, 3), 3
#: Documents of a block, undecided documents of an order of size that a block leaves, and salts of a join.
BLOCK, LEFT, SALTS = 5_000, 3, 64
SIZES = "source int, doc long, size long, chance double, draw long"


def words(text: Column) -> Column:
    """Number of words of a text, whatever its length: each is replaced by one character."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) with ``rank`` and ``target``: all words shared out by weight, no source above ``most``
    times its size, and what is cut off shared again. Each turn is one aggregate; it ends when none is above."""
    ranks = ranked(sizes, [], [F.asc_nulls_last("source")])
    place = (F.pmod(F.col("rank") - 1, F.lit(len(weights)))).cast("int")
    rows = saved(ranks.withColumns({"weight": F.get(F.array(*map(F.lit, weights)), place), "full": F.lit(False)}))
    total = rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    while True:
        sums = rows.agg(F.sum(F.when(F.col("full"), F.col("source_size"))).alias("taken"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open")).first()
        left, share = total - most * (sums["taken"] or 0), sums["open"] or 1
        target = F.when(F.col("full"), most * F.col("source_size").cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / share)
        above = ~F.col("full") & (target > most * F.col("source_size"))
        if rows.filter(above).isEmpty():
            return rows.select("source", "source_size", "rank", target.alias("target"))
        rows = saved(rows.withColumn("full", F.col("full") | above))


def step(chances: list[float], sizes: list[int], draw: float) -> list[float]:
    """Three undecided documents after a move that keeps their number and words, on which one is decided."""
    a, b, c = sizes
    way = [b - c, c - a, a - b] if a != b or b != c else [1, -1, 0]
    up = min(((1 - p) / w if w > 0 else p / -w) for p, w in zip(chances, way) if w)
    down = min((p / w if w > 0 else (1 - p) / -w) for p, w in zip(chances, way) if w)
    # up with probability down / (up + down), so that chances are kept
    by = up if draw * (up + down) < down else -down
    moved = [p + by * w for p, w in zip(chances, way)]
    near = [min(p, 1 - p) if w else 1.0 for p, w in zip(moved, way)]
    hit = near.index(min(near))
    moved[hit] = float(round(moved[hit]))
    return [float(round(p)) if min(p, 1 - p) < 1e-12 else p for p in moved]


def flight(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray, left: int = LEFT) -> np.ndarray:
    """Chances after the flight of documents in order: 0 or 1, but for the last ``left`` of each order of size, which
    wait, and at most two that can't move any more."""
    out = chances.copy()
    order = np.frexp(np.maximum(sizes, 1).astype(np.float64))[1]
    later = np.zeros(len(sizes), np.int64)  # documents of the same order of size that come after
    for o in np.unique(order):
        at = np.flatnonzero(order == o)
        later[at] = np.arange(len(at))[::-1]
    flying: list[int] = []
    for i in np.flatnonzero(later >= left).tolist():
        if not 0 < out[i] < 1:
            continue
        flying.append(i)
        if len(flying) == 3:
            moved = step([float(out[j]) for j in flying], [int(sizes[j]) for j in flying], float(draws[i]))
            out[flying] = moved
            flying = [j for j, p in zip(flying, moved) if 0 < p < 1]
    return out


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Every chance made 0 or 1, from the largest document to the smallest, so that the words taken stay nearest to
    those expected; a tie leaves the document out."""
    out, over = chances.copy(), 0.0
    for i in np.argsort(-sizes, kind="stable").tolist():
        if 0 < out[i] < 1:
            size, chance = int(sizes[i]), float(out[i])
            # over: words taken so far beyond those expected
            out[i] = 1.0 if abs(over + size * (1 - chance)) < abs(over - size * chance) or (size == 0 and chance > 0.5) else 0.0
            over += size * (out[i] - chance)
    return out


def flown(rows: DataFrame, blocks: Column, last: bool) -> DataFrame:
    """Each block of each source after its flight (and, in the last round, its landing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            take = lambda c: block.column(c).to_numpy(zero_copy_only=False)
            sizes, draws = take("size"), take("draw")
            unit = (draws.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
            chances = flight(sizes, take("chance").astype(np.float64), unit)
            chances = landing(sizes, chances) if last else chances
            return pa.RecordBatch.from_arrays([*(block.column(c) for c in ("source", "doc", "size")), pa.array(chances), block.column("draw")], ["source", "doc", "size", "chance", "draw"])

        for batch in batches:
            if not len(batch):
                continue
            source, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "block"))
            cuts = np.flatnonzero((source[1:] != source[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if held and now != (source[a], block[a]):
                    yield done()
                    held = []
                now = (source[a], block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("draw", F.lit(7)), blocks).cast("int"))
    # ties are equal in every column that matters
    return dealt.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("size"), "draw", "doc").mapInArrow(run, SIZES)


def decided(rows: DataFrame) -> DataFrame:
    """SIZES with undecided chances, all of them decided, each source by itself: flights in fewer and fewer blocks."""
    done = None
    rows = saved(rows)
    while True:
        per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = per.agg(F.max("n").alias("n")).first()["n"] or 0
        last = most <= BLOCK
        if last:
            out = flown(rows, F.lit(1), True)
            return out if done is None else done.unionByName(out)
        counted = per.select("source", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        after = saved(flown(_beside(rows, counted, "source"), F.col("blocks"), False))
        ready = after.filter("chance IN (0, 1)")
        done = ready if done is None else done.unionByName(ready)
        rows = after.filter("chance NOT IN (0, 1)")


def _beside(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a table of one row per ``key``, by broadcast if that is small by count, else salted."""
    right = small.withColumnRenamed(key, "key_")
    if small.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("key_"))).drop("key_")
    salted = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("at_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return left.join(salted, F.col(key).eqNullSafe(F.col("key_")) & (F.col("at_") == F.col("salt_"))).drop("key_", "salt_", "at_")


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    rows = saved(docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{source}`").alias("name"), words(F.col(f"`{text}`")).alias("size")))
    sources = saved(targets(rows.groupBy(F.col("name").alias("source")).agg(F.sum("size").alias("source_size")), weights, most))
    wide = _beside(rows, sources.withColumnRenamed("source", "name"), "name")
    often = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    wide = wide.select("doc", "size", F.col("rank").cast("int").alias("source"), "source_size", "target", F.floor(often).alias("whole"), (often - F.floor(often)).alias("chance"), F.xxhash64("doc", "size", "name").alias("draw"))
    fraction = wide.filter("chance > 0 AND size > 0")
    drawn = decided(fraction.select("source", "doc", "size", "chance", "draw"))
    sure = wide.filter("NOT (chance > 0 AND size > 0)").select("doc", "size", "source_size", "target", F.col("whole").alias("copies"))
    back = _beside(drawn, sources.select(F.col("rank").cast("int").alias("source"), "source_size", "target"), "source")
    ratio = F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    taken = back.select("doc", "size", "source_size", "target", (F.floor(ratio) + F.col("chance").cast("long")).alias("copies"))
    out = sure.unionByName(taken)
    return out.select(F.col("doc").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
