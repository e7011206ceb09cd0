"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark's items: ``window`` consecutive words, or all words of a
shorter item. Patterns of one length m are searched together. A shift table, indexed by a hash of
the last few words of the text window, says how far the window may move; where the shift is 0, the
bucket of that suffix hash selects patterns, and a direct comparison of all m words confirms. All
documents of an Arrow slice are searched at once: one cursor per document, numpy per step.

At scale the corpus is never shuffled: documents stream through the search where they are read. The
benchmark is a stated query set; it travels in blocks of at most ``block_chars`` characters, each
broadcast by itself, and a document passes through the blocks one after another.

Defined results: null or wordless text has no words and no hits; a null item or one without words
has no window; an empty benchmark hits nothing; items with the same id count once; items with a null
id mark words but aren't listed; repeated documents are searched each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.arrowtext import bounded_batches, bundled, fold_table, ragged, slices, unbundled, words

WINDOW = 10
BLOCK_CHARS = 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shifts:
    """Tables for patterns of one length: rows of ``patterns`` are distinct windows of word numbers."""

    def __init__(self, patterns: np.ndarray):
        self.m = patterns.shape[1]
        self.block = min(3 if self.m >= 5 else 2, self.m)
        self.bits = int(np.clip(np.ceil(np.log2(8 * patterns.size + 1)), 12, 22))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int64)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self.suffix(patterns, end), self.m - 1 - end)
        suffix = self.suffix(patterns, self.m - 1)
        whole = self.mixed(patterns)
        order = np.lexsort((whole, suffix))
        self.order, self.patterns, self.whole, self.suffixes = order, patterns[order], whole[order], suffix[order]

    def suffix(self, rows: np.ndarray, end: int) -> np.ndarray:
        return (self.mixed(rows[:, end - self.block + 1 : end + 1]) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def mixed(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            h = (h ^ column.astype(np.uint64)) * MIX
            h ^= h >> np.uint64(29)
        return h

    def search(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, pattern) of every occurrence that lies within a document's words."""
        doc = np.flatnonzero(ends - starts >= self.m)
        at, ends = starts[doc] + self.m - 1, ends[doc]
        found = [(np.zeros(0, np.int64),) * 3]
        behind = np.arange(1 - self.block, 1)
        row = np.arange(1 - self.m, 1)
        # bucket of a suffix hash: its patterns lie together, ordered by the hash of the whole window
        first = np.searchsorted(self.suffixes, np.arange((1 << self.bits) + 1))
        while len(at):
            h = self.suffix(text[at[:, None] + behind], self.block - 1)
            move = self.shift[h]
            if len(stop := np.flatnonzero(move == 0)):
                move[stop] = 1
                stop = stop[first[h[stop] + 1] > first[h[stop]]]
                window = text[at[stop][:, None] + row]
                low, high, want = first[h[stop]], first[h[stop] + 1], self.mixed(window)
                while (open_ := low < high).any():  # binary search within each bucket
                    middle = (low + high) // 2
                    less = open_ & (self.whole[np.minimum(middle, len(self.whole) - 1)] < want)
                    low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
                inside = low < first[h[stop] + 1]
                stop, window, low = stop[inside], window[inside], low[inside]
                same = (self.patterns[low] == window).all(axis=1)
                found.append((doc[stop[same]], at[stop[same]] - self.m + 1, self.order[low[same]]))
            at = at + move
            on = at < ends
            at, ends, doc = at[on], ends[on], doc[on]
        return tuple(np.concatenate(x) for x in zip(*found))


class Patterns:
    """All windows of a block of items, by length."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int = WINDOW):
        w = words(pa.array(texts, pa.large_string()), fold_table(separators=True))
        self.number = {x: i + 1 for i, x in enumerate(w.distinct)}
        of = np.diff(w.offsets)
        self.ids, self.searches = ids, []
        lengths = np.minimum(of, window)
        for m in np.unique(lengths[lengths > 0]).tolist():
            items = np.flatnonzero(lengths == m)
            each = np.maximum(of[items] - m, 0) + 1
            starts = ragged(w.offsets[items], each)
            distinct, which = np.unique(w.codes[starts[:, None] + np.arange(m)] + 1, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat(items, each)], axis=1), axis=0)
            self.searches.append((Shifts(distinct), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))

    def occurrences(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """(word offsets of the texts, per pattern length: m, documents, first words, and distinct (document, item))."""
        w = words(texts, fold_table(separators=True))
        number = np.fromiter((self.number.get(x, 0) for x in w.distinct), np.int64, len(w.distinct))
        text = number[w.codes] if len(w.codes) else np.zeros(0, np.int64)
        out = []
        for shifts, bounds, items in self.searches:
            doc, start, pattern = shifts.search(text, w.offsets[:-1], w.offsets[1:])
            n = bounds[pattern + 1] - bounds[pattern]
            pairs = np.stack([np.repeat(doc, n), items[ragged(bounds[pattern], n)]], axis=1)
            out.append((shifts.m, doc, start, np.unique(pairs, axis=0)))
        return w.offsets, out


def marked(rows: DataFrame, benchmark: DataFrame, *, item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``rows`` (text and others) with a struct ``found``: n_words, spans (first and end word of the hit
    stretches, flat, disjoint, ascending) and items (ids, as strings)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = rows.withColumn("found", F.lit(None).cast("struct<n_words:bigint,spans:array<int>,items:array<string>>"))
    for block in range(blocks):
        chosen = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast((tuple(r.id for r in chosen), tuple(r.text for r in chosen)))
        found = found.mapInArrow(_searching(shared, window), found.schema)
    return found


_BUILT: dict = {}


def _searching(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        key = hash((ids, texts, window))
        if key not in _BUILT:
            _BUILT.clear()  # a worker that is used again keeps one block's tables
            _BUILT[key] = Patterns(list(ids), list(texts), window)
        patterns = _BUILT[key]
        for batch in batches:
            at = batch.schema.get_field_index("found")
            for rows, whole in slices(batch, "text"):
                offsets, occurrences = patterns.occurrences(whole)
                old = rows.column("found").to_pylist()
                edge = np.zeros(int(offsets[-1]) + 1, np.int32)
                named: dict[int, set] = {}
                for i, x in enumerate(old):
                    if x and x["spans"]:
                        s = np.array(x["spans"]).reshape(-1, 2) + offsets[i]
                        np.add.at(edge, s[:, 0], 1)
                        np.add.at(edge, s[:, 1], -1)
                    if x and x["items"]:
                        named[i] = set(x["items"])
                for m, _, start, pairs in occurrences:
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + m, -1)
                    for d, item in pairs.tolist():
                        if ids[item] is not None:
                            named.setdefault(d, set()).add(ids[item])
                hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                turn = hit[1:] != hit[:-1]
                turn[offsets] |= hit[1:][offsets] & hit[:-1][offsets]  # a stretch ends with its document
                values = []
                begins = np.flatnonzero(turn & hit[1:])
                ends = np.flatnonzero(turn & hit[:-1])
                of = np.searchsorted(offsets, begins, side="right") - 1
                spans: dict[int, list[int]] = {}
                for d, a, b in zip(of.tolist(), begins.tolist(), ends.tolist()):
                    base = int(offsets[d])
                    spans.setdefault(d, []).extend((a - base, b - base))
                sizes = np.diff(offsets).tolist()
                for i in range(rows.num_rows):
                    values.append({"n_words": sizes[i], "spans": spans.get(i, []), "items": sorted(named.get(i, ()))})
                columns = list(rows.columns)
                columns[at] = pa.array(values, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = marked(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    hit = F.aggregate(F.transform("found.spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("found.spans").alias("spans"), F.col("found.items").alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents of which no word is hit, with the columns they came with."""
    found = marked(bundled(docs, text), benchmark, **options)
    return unbundled(found.filter(F.size("found.spans") == 0), docs.columns, text)
