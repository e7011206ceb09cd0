"""Token counts of documents in flat token files that carry no index.

A flat file is nothing but fixed-width little-endian ids, each document followed by a separator id.
Files are cut into blocks of equal length; a task searches a block for the separator with one
vectorised comparison, and a prefix scan over the blocks of a file (within runs of blocks, then over
the runs) gives each block the number of separators and the position of the last one before it.
That stitches documents over block boundaries, however many blocks one spans, without any task
ever holding more than one block of tokens.

Defined results: an empty file has no documents; tokens after the last separator make a last document
with ``terminated`` false; two separators in a row make a document of 0 tokens; null texts are
written as empty; a file whose length isn't a whole number of ids raises, and so does an id of a larger
vocabulary that 16 bits can't hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.llm.arrowtext import bounded_batches, slices
from confluo.llm.jobs import checkpoint_dir, saved, shuffle_partitions
from confluo.llm.tokenizer import default_path, loaded
from confluo.session import removed

#: Outside the vocabulary of 49,408 ids, so no text can hold it.
SEPARATOR = 65_535
BLOCK_TOKENS = 1 << 20
RUN_BLOCKS = 1024


def opened(uri: str):
    """(file system, path) of a Spark path, for a Python worker."""
    import pyarrow.fs as pafs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, *, text: str = "text", key: str = "doc_id", tokenizer_path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Write one flat uint16 file per partition; (file_no, ordinal, doc_id) says which document is where.
    A file appears under its name only when complete, and a task that runs again writes the same one."""
    raw = open(tokenizer_path or default_path(), encoding="utf-8").read()
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/_part-{number:06d}-{uuid.uuid4().hex}"
        seen = 0
        with files.open_output_stream(name) as out:
            for batch in batches:
                for rows, texts in slices(batch, "text"):
                    _, ids = loaded(shared.value).batch(texts, separator)
                    if len(ids) and ids.max() > 65_535:
                        raise ValueError("an id doesn't fit in 16 bits")
                    out.write(ids.astype("<u2").tobytes())
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(np.arange(seen, seen + n)), rows.column("doc_id")], ["file_no", "ordinal", "doc_id"])
                    seen += n
        final = f"{base}/part-{number:06d}.tok"
        if files.get_file_info(final).type.name != "NotFound":
            files.delete_file(final)
        files.move(name, final)

    return saved(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "file_no int, ordinal long, doc_id long"))


def separator_blocks(spark: SparkSession, folder: str, separator: int, block_tokens: int, dtype: str) -> DataFrame:
    """(path, block, size, found): the separators' positions in each block of the folder's files."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "length").filter("length > 0")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (block_tokens * width)).cast("long"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, block in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "block"))):
                if length % width:
                    raise ValueError(f"{path} isn't a whole number of {width}-byte ids")
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    data = f.read_at(min(block_tokens * width, length - block * block_tokens * width), block * block_tokens * width)
                found = np.flatnonzero(np.frombuffer(data, dtype) == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([len(data) // width], pa.int64()), pa.array([found], pa.list_(pa.int32()))], ["path", "block", "size", "found"])

    return blocks.repartition(shuffle_partitions(spark), "path", "block").mapInArrow(run, "path string, block long, size long, found array<int>")


def token_counts(spark: SparkSession, folder: str, *, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """One row per document of each file: path, ordinal, start, n_tokens (without the separator), terminated."""
    blocks = saved(separator_blocks(spark, folder, separator, block_tokens, dtype))
    base = F.col("block") * block_tokens
    marks = blocks.select("path", "block", F.floor(F.col("block") / RUN_BLOCKS).alias("run"), (base + F.col("size")).alias("upto"), F.size("found").cast("long").alias("n"), (base + F.try_element_at("found", F.lit(-1))).alias("last"))
    # scan within runs of blocks, then over the runs: sums of counts, maxima of the last position
    before = Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = marks.select("path", "run", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_in"), F.max("last").over(before).alias("last_in"))
    runs = marks.groupBy("path", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    above = Window.partitionBy("path").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    over = runs.select("path", "run", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_over"), F.max("last").over(above).alias("last_over"))
    scan = within.join(over, ["path", "run"]).select("path", "block", (F.col("n_in") + F.col("n_over")).alias("before"), (F.coalesce("last_in", "last_over", F.lit(-1)) + 1).alias("from"))
    at = lambda i: F.get("found", i) + F.col("block") * block_tokens
    spans = F.transform("found", lambda x, i: F.struct((F.col("before") + i).alias("ordinal"), F.when(i == 0, F.col("from")).otherwise(at(i - 1) + 1).alias("start"), (x + F.col("block") * block_tokens).alias("stop")))
    ended = blocks.join(scan, ["path", "block"]).select("path", F.inline(spans)).select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    files = marks.groupBy("path").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("upto").alias("upto"))
    rest = files.filter("start < upto").select("path", "ordinal", "start", (F.col("upto") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(rest)


def document_token_counts(docs: DataFrame, **names) -> DataFrame:
    """Write ``docs`` as flat token files in the shared folder, then count by scanning: doc_id, file_no,
    ordinal, start, n_tokens."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    placed = write_token_files(docs, folder, **names)
    number = F.regexp_extract("path", r"part-(\d+)\.tok", 1).cast("int")
    counts = token_counts(spark, folder).select(number.alias("file_no"), "ordinal", "start", "n_tokens")
    removed(spark, folder)  # the separators' places are saved
    return placed.join(counts, ["file_no", "ordinal"]).select("doc_id", "file_no", "ordinal", "start", "n_tokens")
