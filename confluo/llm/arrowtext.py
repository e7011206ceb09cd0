"""Columnar text helpers shared by the Arrow-batch operators.

A batch of texts is cut into words once, in C++, and dictionary-encoded, so Python only ever
touches each distinct word of a batch; everything per occurrence is a numpy gather.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once: what is made of them takes many times as much memory.
SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
#: Bytes of one text that are cut into words at once.
SPAN_BYTES = 2 << 20
#: The bytes that separate words.
SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def bounded_batches(spark) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bundled(docs, text: str):
    """(text, row): the text and, in one struct, all other columns, whatever their names."""
    from pyspark.sql import functions as F

    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    return docs.select(F.col(f"`{text}`").alias("text"), F.struct(F.lit(0).alias("none"), *rest).alias("row"))


def unbundled(rows, columns: list[str], text: str):
    """The columns that ``bundled`` packed, as they were."""
    from pyspark.sql import functions as F

    return rows.select(*(F.col("text" if c == text else f"row.c{i}").alias(c) for i, c in enumerate(columns)))


def relieved() -> None:
    """Give memory that is free again back to the system: workers are used again and live long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """(slice of the batch, its texts with null as '') with about ``limit`` bytes of text each; a longer
    text has a slice of its own."""
    texts = batch.column(column)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to
    relieved()


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Each byte of the texts through a 256-entry table that leaves bytes from 0x80 alone."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(table[raw].tobytes()))


def fold_table(separators: bool = False) -> np.ndarray:
    """A-Z to a-z; with ``separators`` every other ASCII byte that isn't a letter or digit to a space."""
    table = np.arange(256, dtype=np.uint8)
    if separators:
        table[:128] = 32
        for low, high in ((48, 58), (97, 123)):
            table[low:high] = np.arange(low, high)
    table[65:91] = np.arange(97, 123)
    return table


@dataclass
class Words:
    """Words of several texts: text i has ``codes[offsets[i]:offsets[i + 1]]``, indices into ``distinct``."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: list[str]


def words(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """Runs of anything but ASCII white space, after the byte table if one is given. Long texts are cut in
    spans of whole words, so that beside the codes only the words of a span are held at once."""
    if table is not None:
        texts = translated(texts, table)
    if len(texts) == 0 or pc.max(pc.binary_length(texts)).as_py() <= SPAN_BYTES:
        return _words(texts)
    number: dict[str, int] = {}
    sizes, codes = [], []
    for i in range(len(texts)):
        size = 0
        for span in spans(texts[i]):
            w = _words(span)
            known = np.fromiter((number.setdefault(x, len(number)) for x in w.distinct), np.int64, len(w.distinct))
            codes.append(known[w.codes].astype(np.int32) if len(w.codes) else np.zeros(0, np.int32))
            size += len(w.codes)
        sizes.append(size)
    return Words(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate(codes), list(number))


def spans(text: pa.LargeStringScalar):
    """A text as arrays of one string each, cut behind white space; a word longer than a span stays whole."""
    data = text.as_buffer()
    raw = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(raw) or at == 0:
        to = min(at + SPAN_BYTES, len(raw))
        if to < len(raw):
            space = np.flatnonzero(SPACES[raw[at:to]])
            if len(space):
                to = at + int(space[-1]) + 1
            else:
                later = np.flatnonzero(SPACES[raw[to:]])
                to = to + int(later[0]) + 1 if len(later) else len(raw)
        yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, to - at], np.int64)), data.slice(at, to - at))
        at = max(to, 1)


def _words(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    offsets, codes = bounds - bounds[0], encoded.indices.to_numpy(zero_copy_only=False)
    distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in distinct:
        empty = distinct.index("")
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return Words(offsets, codes, distinct)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (lengths[i] of them), one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
