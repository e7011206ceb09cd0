"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Coordinates: every shingle goes through one permutation of the 32-bit universe; coordinate k is the
minimum, over the set, of a second permutation applied after a circular shift by k. Two permutations
thus give all coordinates, whatever their number.

From signatures to groups, without ever emitting the pairs within a group:

1. Documents with the same set form a class (one row each from here on; hot groups of copies are
   pre-aggregated).
2. Classes that agree on a band meet in a bucket. Each member is linked only to the bucket's smallest
   member, so a bucket of n costs n - 1 candidates. Candidates are verified on the full sets: texts
   travel to their candidate leader, dealt in bounded portions, with the leader's text once a portion.
3. Connected components of verified links, by alternating stars.
4. Members of a bucket that its leader didn't tie together could still be linked to each other. All
   members of such buckets go through an exact prefix-filter join: shingles are ordered from rare to
   common, and two sets of similarity s must share one of the first n - ceil(s n) + 1, early enough for
   the rest to hold the overlap that their sizes require. A passage that many texts share is common,
   hence last, so it makes few candidates. Sets that share a key with many others meet only those whose size and
   parity bits leave room for the overlap. Long keys are dealt in bounded portions. New links join step 3's.

A pair at the threshold misses all bands with probability (1 - t^rows)^bands: 2.7e-5 for 20 bands of
4 rows at 0.8, and less above it.

Defined results: null, empty or blank text has an empty set and is linked with nothing; fewer words
than a shingle make one shingle of them all; rows with one id are one document; a row with a null id
is linked with nothing and kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.arrowtext import bounded_batches, fold_table, slices, words
from confluo.llm.jobs import if_small, saved, shuffle_partitions
from confluo.operators.joins import beside

#: Bits of the bounded table of shingle frequencies, and about how many documents meet their leader in one portion.
FREQUENCY_BITS = 20
PORTION = 256

#: Bits of a set's parities, and classes of size per factor e where long keys meet.
PARITY_BITS, SIZE_STEPS = 512, 20


@dataclass(frozen=True)
class Similarity:
    """Sets of ``shingle``-word shingles, linked from a similarity of ``percent`` / 100."""

    shingle: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 4


def permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place; odd factors and shifted differences can be undone."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


#: Factors of the two permutations: the one that shuffles the shingles, and the one that is shifted.
SHUFFLING, SHIFTED = (0x85EBCA6B, 0xC2B2AE35), (0x7FEB352D, 0x846CA68B)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def circulant_minima(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least of the shingles' numbers in the shifted permutation, turned by k places."""
    first = permuted((mixed(shingles) >> np.uint64(32)).astype(np.uint32), *SHUFFLING)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 2048):
        np.minimum(least, permuted(first[None, at : at + 2048] + shifts, *SHIFTED).min(axis=1), out=least)
    return least


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    w = words(texts, fold_table())
    each = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w.distinct), np.uint64, len(w.distinct))
    h = each[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        rolled = mixed(rolled + h[k : len(h) - size + 1 + k])
    out = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            short = np.zeros(min(1, b - a), np.uint64)
            for x in h[a:b]:
                short = mixed(short + x)
            out.append(short)
    return out


def sketches(docs: DataFrame, of: Similarity) -> DataFrame:
    """doc_id, n_shingles, set_hi, set_lo and one long per band (null for an empty set)."""
    bands = [f"band_{i}" for i in range(of.bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, of.bands + 1, dtype=np.uint64)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                sets = shingle_sets(texts, of.shingle)
                digests, signed = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), of.bands), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        d = xxhash.xxh3_128_intdigest(s.tobytes())
                        digests[i] = d >> 64, d & (2**64 - 1)
                        key = salt
                        for column in circulant_minima(s, of.bands * of.rows).reshape(of.bands, of.rows).T:
                            key = mixed(key + column)
                        signed[i] = key
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                empty = sizes == 0
                longs = [pa.array(x.astype(np.int64), mask=empty) for x in (*digests.T, *signed.T)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), *longs], ["doc_id", "n_shingles", "set_hi", "set_lo", *bands])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long, n_shingles long, set_hi long, set_lo long", *(f"{b} long" for b in bands)]))


def verified(docs: DataFrame, pairs: DataFrame, of: Similarity) -> DataFrame:
    """Those (id, leader) of ``pairs`` (with parts) whose full sets are similar enough. Members meet their
    leader in ``parts`` portions, so neither a leader's popularity nor a group's size makes a task large."""
    spark = docs.sparkSession
    portion = F.struct("parts", F.pmod(F.xxhash64("id", "leader"), F.col("parts"))).alias("portion")
    members = pairs.select("id", "leader", portion, F.lit(False).alias("leads"))
    leaders = members.select("leader", "portion").distinct().select(F.col("leader").alias("id"), "leader", "portion", F.lit(True).alias("leads"))
    meetings = members.unionByName(leaders)
    wanted = if_small(saved(meetings.select("id").distinct()))
    rows = docs.filter("doc_id IS NOT NULL").join(wanted, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text")
    joined = meetings.join(rows, "id").repartition(shuffle_partitions(spark) * 2, "leader", "portion").sortWithinPartitions("leader", "portion", F.desc("leads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, []
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = shingle_sets(texts, of.shingle)
                out = []
                for leader, portion, leads, own, s in zip(*(part.column(c).to_pylist() for c in ("leader", "portion", "leads", "id")), sets):
                    if now != (leader, portion):
                        now, lead = (leader, portion), []
                    if leads:
                        lead.append(s)
                        continue
                    for other in lead:
                        low, high = sorted((len(s), len(other)))
                        if 100 * low < of.percent * high or not low:
                            continue
                        place = np.minimum(np.searchsorted(other, s), len(other) - 1)
                        common = int((other[place] == s).sum())
                        if 100 * common >= of.percent * (len(s) + len(other) - common):
                            out.append((own, leader))
                            break
                if out:
                    a, b = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id", "leader"])

    return joined.select("leader", "portion", "leads", "id", "text").mapInArrow(run, "id long, leader long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches, by alternating large and small
    stars. A hub's star is only an aggregate and a join on its id; no group is gathered."""
    a, b = F.least("id", "leader"), F.greatest("id", "leader")
    links = saved(links.select(b.alias("id"), a.alias("leader")).filter("id <> leader").distinct())
    while True:
        # large star: a node's larger neighbours (and itself) hang on its smallest neighbour
        both = links.unionByName(links.select(F.col("leader").alias("id"), F.col("id").alias("leader")))
        least = both.groupBy("id").agg(F.least(F.min("leader"), F.col("id")).alias("least"))
        large = both.filter("leader > id").join(least, "id").select(F.col("leader").alias("id"), F.col("least").alias("leader")).distinct()
        # small star: smaller neighbours and the node itself hang on the smallest of them
        low = large.groupBy("id").agg(F.min("leader").alias("least"))
        small = large.join(low, "id").select(F.when(F.col("leader") == F.col("least"), F.col("id")).otherwise(F.col("leader")).alias("id"), F.col("least").alias("leader"))
        again = saved(small.filter("id <> leader").distinct())
        if not again.count():
            return again.select("id", F.col("leader").alias("component"))
        stars = again.groupBy().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).first()
        hubs = again.select("leader").distinct().join(again.select("id").distinct(), F.col("leader") == F.col("id"), "left_semi").limit(1).count()
        if stars.n == stars.ids and not hubs:
            return again.select("id", F.col("leader").alias("component"))
        links = again


def rarest_first(docs: DataFrame, ids: DataFrame, of: Similarity) -> DataFrame:
    """Candidates (id, leader), id > leader, of different components among ``ids`` (id, component, n): a
    superset of all pairs at the threshold, from the rare ends of their sets."""
    spark = docs.sparkSession
    texts = saved(docs.filter("doc_id IS NOT NULL").join(if_small(ids), F.col("doc_id") == F.col("id")).select("id", "component", "text"))
    cells = 1 << FREQUENCY_BITS

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, column in slices(batch, "text"):
                sets = shingle_sets(column, of.shingle)
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(total[at[k : k + 100_000]])], ["cell", "n"])

    # at most 2^20 rows, whatever the corpus
    counted = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(cells, np.int64)
    total[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(np.minimum(total, 2**31 - 1).astype(np.int32))

    def prefixes(batches):
        for batch in batches:
            for part, column in slices(batch, "text"):
                frequency = shared.value
                sets = shingle_sets(column, of.shingle)
                keys, places, each = [], [], []
                for s in sets:
                    keep = len(s) - -(-of.percent * len(s) // 100) + 1 if len(s) else 0
                    seen = frequency[(s >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
                    order = np.lexsort((s, seen))[:keep]
                    shared_ = np.flatnonzero(seen[order] > 1)  # a shingle seen once is in no other set
                    keys.append(s[order[shared_]].astype(np.int64))
                    places.append(shared_)
                    each.append(len(shared_))
                index = pa.array(np.repeat(np.arange(len(each)), each))
                size = np.repeat(np.fromiter(map(len, sets), np.int64, len(sets)), each)
                yield pa.RecordBatch.from_arrays([part.column("id").take(index), part.column("component").take(index), pa.array(size), pa.array(np.concatenate(places)), pa.array(np.concatenate(keys))], ["id", "component", "size", "place", "key"])

    heads = saved(texts.mapInArrow(prefixes, "id long, component long, size long, place long, key long"))
    # within a key only pairs of different components count, so its largest component needn't meet itself
    sizes = heads.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    met = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("components"), F.sum("n").alias("members"))
    met = saved(met.filter("components > 1").select("key", "largest", "members"))
    short, long = met.filter(F.col("members") <= PORTION), saved(met.filter(F.col("members") > PORTION))
    tagged = heads.join(if_small(short), "key")
    near = tagged.filter("component <> largest").alias("x").join(tagged.alias("y"), F.expr("x.key = y.key AND x.component <> y.component AND (y.component = x.largest OR x.id > y.id)") & reachable(of))
    found = ordered(near)
    if not long.isEmpty():
        found = found.unionByName(meetings_of_long_keys(firsts(heads.join(if_small(long), "key")), texts, of))
    return found.distinct()


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x.id", "y.id").alias("id"), F.least("x.id", "y.id").alias("leader"))


def reachable(of: Similarity) -> Column:
    """What follows a common shingle bounds the overlap of x and y, and their sizes say how large it must be."""
    both = (F.col("x.size") + F.col("y.size")) * of.percent
    return ((F.col("x.size") - F.col("x.place")) * (100 + of.percent) >= both) & ((F.col("y.size") - F.col("y.place")) * (100 + of.percent) >= both)


def firsts(heads: DataFrame) -> DataFrame:
    """Of keys that the same sets share, such as those of one passage, only the first in order: whoever meets at
    another of them meets there. Two digests of 64 bits and the number of members tell which keys these are."""
    digests = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"digest_{k}") for k in range(2)]
    keys = heads.groupBy("key", "members").agg(*digests, F.min("place").alias("place"))
    kept = saved(keys.groupBy("members", "digest_0", "digest_1").agg(F.min(F.struct("place", "key"))["key"].alias("key")).select("key"))
    return heads.join(if_small(kept), "key")


def parities(texts: DataFrame, of: Similarity) -> DataFrame:
    """(id, parity_0..): PARITY_BITS bits per set, each the parity of the shingles that fall on it. Sets differ in
    at least as many shingles as their bits differ."""
    names = [f"parity_{i}" for i in range(PARITY_BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in slices(batch, "text"):
                odd = [np.bincount((mixed(s) >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1 for s in shingle_sets(column, of.shingle)]
                bits = np.packbits(np.array(odd, np.uint8).reshape(-1, PARITY_BITS), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], ["id", *names])

    return texts.select("id", "text").mapInArrow(run, ", ".join(["id long", *(f"{n} long" for n in names)]))


def meetings_of_long_keys(heads: DataFrame, texts: DataFrame, of: Similarity) -> DataFrame:
    """Candidates among entries of keys that many sets share. Entries meet only in cells of a key, where sizes and
    what follows the key leave room for the overlap; there, parities rule out nearly all pairs of different sets
    before a text is read. The one side of a cell is dealt to portions."""
    ids = saved(heads.select("id").distinct())
    bits = parities(texts.join(if_small(ids), "id", "left_semi"), of)
    heads = saved(heads.join(bits, "id"))
    step = lambda n: F.floor(F.log(n.cast("double")) * SIZE_STEPS)
    size, after, whole = F.col("size"), F.col("size") - F.col("place"), 100 + of.percent
    # sizes that a partner of this entry can have
    least, most = F.ceil(size * of.percent / 100), F.least(F.floor(size * 100 / of.percent), F.floor(after * whole / of.percent) - size)
    # x has the smaller set in cells of the first kind, and the larger one in those of the second
    smaller = lambda first: heads.filter(most >= size).select("*", F.lit(first).alias("kind"), step(size).alias("low"), F.explode(F.sequence(step(size), step(most))).alias("high"))
    larger = lambda first: heads.filter(F.least(most, size) >= least).select("*", F.lit(first).alias("kind"), F.explode(F.sequence(step(least), step(F.least(most, size)))).alias("low"), step(size).alias("high"))
    cell = ["key", "kind", "low", "high"]
    left = smaller(True).unionByName(larger(False)).filter("component <> largest")
    right = larger(True).unionByName(smaller(False))
    parts = saved(left.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("parts")))
    left = left.join(if_small(parts), cell).withColumn("portion", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("x")
    right = right.join(if_small(parts), cell).withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    same = reduce(lambda a, b: a & b, (F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*cell, "portion"]))
    sided = F.expr("CASE WHEN x.kind THEN x.size <= y.size ELSE x.size > y.size END AND x.component <> y.component AND (y.component = x.largest OR x.id > y.id)")
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.parity_{i}").bitwiseXOR(F.col(f"y.parity_{i}"))) for i in range(PARITY_BITS // 64)))
    both = F.col("x.size") + F.col("y.size")
    return ordered(left.join(right, same & sided & reachable(of) & ((both - differ) * whole >= both * (2 * of.percent))))


def near_duplicates(docs: DataFrame, of: Similarity = Similarity(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id
    (smallest id reachable over links) and kept (the document is its component's)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = saved(sketches(docs, of))
    bands = [f"band_{i}" for i in range(of.bands)]
    usable = sketch.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = saved(usable.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), *(F.min(b).alias(b) for b in bands)))
    entries = classes.select("id", "n", F.explode(F.array(*bands)).alias("bucket")).distinct()
    buckets = entries.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count(F.lit(1)).alias("members")).filter("leader <> last")
    entries = saved(entries.join(buckets, "bucket").select("bucket", "id", "n", "leader", "members"))
    pairs = saved(entries.filter("id <> leader").groupBy("id", "leader").agg(F.ceil(F.max("members") / PORTION).cast("int").alias("parts")))
    links = saved(verified(docs, pairs, of))
    found = components(links)
    # buckets whose other members are still apart
    placed = entries.filter("members > 2 AND id <> leader").join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
    rest = saved(placed.join(apart, "bucket").select("id", "component").distinct())
    if not rest.isEmpty():
        untried = saved(rarest_first(docs, rest, of).join(pairs, ["id", "leader"], "left_anti"))
        of_leader = untried.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("parts"))
        more = saved(verified(docs, beside(untried, of_leader, ["leader"]), of))
        if not more.isEmpty():
            found = components(found.select("id", F.col("component").alias("leader")).unionByName(more))
    reps = classes.select("set_hi", "set_lo", F.col("id").alias("class_id")).join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("set_hi", "set_lo", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = sketch.join(reps, ["set_hi", "set_lo"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
