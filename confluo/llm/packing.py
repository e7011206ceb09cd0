"""Sum-of-squares packing of token pieces into fixed-size sequences.

A piece of s tokens goes where the sum, over all residual gaps g, of the squared number of open
sequences with gap g becomes smallest: into an open sequence with room, or a new one. Ties go to the
tightest fit. Only the counts per gap matter for the choice, so the state is one array of
``capacity`` counts plus the open sequences themselves.

At scale: pieces (digests, not ids) are dealt evenly to groups by a hash, each group is packed in
descending order of length, and then the pieces of the sequences that came out short of full are
packed again in far fewer groups. No group depends on a source, length or text, so nothing is hot.

Defined results: null text counts as empty; an empty text still gives its end token, one piece of
length 1; repeated rows are packed each on their own; an empty table gives no rows; other columns of
the table are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.arrowtext import bounded_batches, slices
from confluo.llm.jobs import saved, shuffle_partitions
from confluo.llm.tokenizer import default_path, loaded

CAPACITY = 4096
END_ID = 1
#: Pieces per group in the first round, and sequences fuller than this share stay as they are.
GROUP_PIECES = 20_000
FULL_SHARE = 0.995

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids of each text and its end id; ``ids`` (binary,
    little-endian uint32) only on request, as packing itself doesn't need them."""
    raw = open(tokenizer_path or default_path(), encoding="utf-8").read()
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                offsets, ids = loaded(shared.value).batch(texts, end_id)
                sizes = np.diff(offsets)
                per = -(-sizes // capacity)
                of = np.repeat(np.arange(len(per)), per)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, sizes[of] - start)
                at = offsets[of] + start
                data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                spans = [data[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
                out = [rows.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.tobytes() for x in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


class SumOfSquares:
    """Online packer: ``place(length)`` gives (sequence number, offset in it)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.opened = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap
        self.open: dict[int, list[int]] = defaultdict(list)

    def place(self, size: int) -> tuple[int, int]:
        capacity, counts = self.capacity, self.counts
        gap = capacity
        if size < capacity:
            # change of the sum of squares for each gap that holds the piece; a new sequence is the gap ``capacity``
            change = 1 - 2 * counts[size:]
            change[-1] = 0
            change[1:] += 2 * counts[1 : capacity - size + 1] + 1
            usable = counts[size:] > 0
            usable[-1] = True
            fits = np.flatnonzero(usable)
            gap = size + int(fits[np.argmin(change[fits])])
        if gap == capacity:
            number = self.opened
            self.opened += 1
        else:
            number = self.open[gap].pop()
            counts[gap] -= 1
        if left := gap - size:
            counts[left] += 1
            self.open[left].append(number)
        return number, capacity - gap


def packed_groups(pieces: DataFrame, groups: int, first: int, capacity: int) -> DataFrame:
    """Each of ``groups`` hash groups packed by itself; adds sequence_id, place (its offset) and
    used (tokens in the finished sequence). ``first``: sequence numbers start there, a group apart."""
    schema = pieces.drop("group").schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, parts, placed = None, None, [], []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            number, offset = np.array(placed, np.int64).reshape(-1, 2).T
            used = np.zeros(packer.opened, np.int64)
            np.add.at(used, number, table["length"].to_numpy())
            columns = [table[n].combine_chunks() for n in names]
            return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns), pa.array(first + (group << 32) + number), pa.array(offset), pa.array(used[number])], [*names, "sequence_id", "offset", "used"])

        for batch in batches:
            of = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if of[a] != group:
                    if parts:
                        yield done()
                    group, packer, parts, placed = int(of[a]), SumOfSquares(capacity), [], []
                part = batch.slice(a, b - a)
                parts.append(part.select(names))
                placed.extend(map(packer.place, part.column("length").to_pylist()))
        if parts:
            yield done()

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(first)), F.lit(groups)))
    dealt = dealt.repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long, used long")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with their sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = saved(pieces)
    groups = max(shuffle_partitions(spark), -(-pieces.count() // group_pieces))
    if groups == 1:
        return packed_groups(pieces, 1, 0, capacity).drop("used")
    once = saved(packed_groups(pieces, groups, 0, capacity))
    short = F.col("used") < int(FULL_SHARE * capacity)
    again = once.filter(short).select(pieces.columns)
    left = again.count()
    fewer = max(1, -(-left // group_pieces))
    rest = packed_groups(again, fewer, 1 << 62, capacity)
    return once.filter(~short).unionByName(rest).drop("used")


def pack_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(tokenized_pieces(docs, text=text, key=key, tokenizer_path=tokenizer_path, capacity=capacity, end_id=end_id), capacity=capacity)


def with_ids(packed: DataFrame, docs: DataFrame, *, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Placed pieces with their ids (binary, little-endian uint32). Packing moves digests only; the ids are
    made again and meet their place once, dealt by document and piece. Repeated rows share theirs."""
    at = ["key_", "piece", "start", "length", "ids_crc32"]
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key_")
    pieces = tokenized_pieces(docs, text=text, key=key, with_ids=True, **options)
    ids = pieces.select(named, *at[1:], "ids").groupBy(*at).agg(F.first("ids").alias("ids"))
    return packed.select(named, *packed.columns).join(ids, at).select(*packed.columns, "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """The finished sequences themselves: sequence_id, ids (binary, uint32), from placed pieces with their ids.
    A sequence has at most its capacity of tokens, so each group here is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.aggregate("rows", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
