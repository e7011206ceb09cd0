"""Exact k-means by Drake's adaptive bounds.

Beside its cluster and an upper bound of the distance to it, every vector keeps lower bounds of its NEAR next
centroids, by number, and one lower bound of all the rest. When centroids move, the upper bound grows by its own
centroid's step, the near bounds shrink by theirs and the rest's by the largest step. The cluster stands while the
upper bound is below every lower bound; else the upper bound is made exact; else the near centroids are computed, and
only if the rest's bound can't exclude the others are all centroids scanned again and the near ones chosen anew.
Bounds are square roots in double precision, and compared with a margin, so that a tie or a rounding error always
leads to the exact integer distances.

At scale: vectors stay where they are read. A round is one pass that writes each vector with its bounds, and one that
adds up the clusters' components per batch before they are shuffled; only k centroids go through the driver. A round's
table is removed when the next is written; all of them lie in the folder that executors share.

Defined results: vectors that are null, of another size than DIMENSIONS, or with a null or non-finite component are
left out, and so are those with a component beyond 2^27 after scaling, whose squared distance wouldn't fit a long.
Repeated rows are vectors of their own; among the first centroids, vectors of equal id are in order of their
components, and null ids come last. With fewer vectors than k there are as many centroids as vectors. An empty table
gives no rows. Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.jobs import checkpoint_dir
from confluo.session import removed

DIMENSIONS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Nearest other centroids whose lower bounds a vector keeps.
NEAR = 4
#: Relative margin within which bounds don't decide.
MARGIN = 1e-9
LIMIT = 1 << 27


def scaled(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that count, with integer components floor(scale * component)."""
    at = F.col(f"`{vector}`")
    x = F.transform(at, lambda c: F.floor(scale * F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LIMIT), c.cast("double"))))
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), x.alias("x"), (F.size(at) == dimensions).alias("whole"))
    fits = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) <= LIMIT))
    return rows.filter(F.col("whole") & fits).select("vec_id", F.col("x").cast("array<int>").alias("x"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest sha256 of '1:' and their id."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(name.alias("name"), "x").orderBy(F.asc_nulls_last("name"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["x"]) if rows else 0)


def exact(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each of its centroids, (n, m) from (n, d) and (m, d) or (n, m, d)."""
    out = np.empty((len(x), centroids.shape[-2]), np.int64)
    for j in range(out.shape[1]):
        step = x - centroids[..., j, :]
        out[:, j] = np.einsum("nd,nd->n", step, step)
    return out


def scanned(x: np.ndarray, centroids: np.ndarray, near: int) -> dict[str, np.ndarray]:
    """Cluster, squared distance, and fresh bounds from all centroids; equal distances go to the smaller number."""
    d = exact(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    roots = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = roots[:, near + 1] if d.shape[1] > near + 1 else np.full(len(x), np.inf)
    return {"cluster": order[:, 0].astype(np.int32), "distance": np.take_along_axis(d, order[:, :1], 1)[:, 0], "upper": roots[:, 0], "ids": order[:, 1 : near + 1].astype(np.int32), "lower": roots[:, 1 : near + 1], "rest": rest}


def moved(state: dict[str, np.ndarray], steps: np.ndarray) -> dict[str, np.ndarray]:
    """Bounds after each centroid moved by its step, rounded outwards."""
    upper = (state["upper"] + steps[state["cluster"]]) * (1 + MARGIN)
    lower = (state["lower"] - steps[state["ids"]]) * (1 - MARGIN)
    return state | {"upper": upper, "lower": np.maximum(lower, 0), "rest": np.maximum((state["rest"] - steps.max(initial=0)) * (1 - MARGIN), 0)}


def assigned(x: np.ndarray, state: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """State with each vector's nearest centroid, from bounds where they certify it; and how far each vector had to go:
    0 bounds alone, 1 its own distance, 2 its near centroids, 3 all of them."""
    near = state["ids"].shape[1]
    state = {k: v.copy() for k, v in state.items()}
    went = np.zeros(len(x), np.int8)
    least = np.minimum(state["lower"].min(axis=1, initial=np.inf), state["rest"])
    open_ = np.flatnonzero(~(state["upper"] * (1 + MARGIN) < least * (1 - MARGIN)))
    went[open_] = 1
    own = exact(x[open_], centroids[state["cluster"][open_]][:, None, :])[:, 0]
    state["upper"][open_] = np.sqrt(own.astype(np.float64))
    open_ = open_[~(state["upper"][open_] * (1 + MARGIN) < least[open_] * (1 - MARGIN))]
    went[open_] = 2
    # the cluster and its near centroids, in order of distance, then of number
    mine = np.concatenate([state["cluster"][open_][:, None], state["ids"][open_]], axis=1)
    d = exact(x[open_], centroids[mine])
    order = np.lexsort((mine, d), axis=1)
    mine, d = np.take_along_axis(mine, order, 1), np.take_along_axis(d, order, 1)
    roots = np.sqrt(d.astype(np.float64))
    sure = roots[:, 0] * (1 + MARGIN) < state["rest"][open_] * (1 - MARGIN)
    at = open_[sure]
    state["cluster"][at], state["upper"][at] = mine[sure, 0], roots[sure, 0]
    state["ids"][at], state["lower"][at] = mine[sure, 1:], roots[sure, 1:]
    at = open_[~sure]
    went[at] = 3
    for name, values in scanned(x[at], centroids, near).items():
        if name != "distance":
            state[name][at] = values
    return state, went


STATE = "vec_id {key}, x array<int>, cluster int, upper double, ids array<int>, lower array<double>, rest double, went byte"


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * width, pa.array(np.ascontiguousarray(values).ravel(), kind))


def _matrix(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    column = batch.column(name)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def assign(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, near: int = NEAR) -> DataFrame:
    """One round: vectors (without bounds if ``before``, the centroids they were made with, is none) with their state."""
    near = min(near, len(centroids) - 1)
    # rounded up: a step must not be less than what the centroid moved
    steps = None if before is None else np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch, "x", np.int64)
            if steps is None:
                state, went = scanned(x, centroids, near), np.full(len(x), 3, np.int8)
            else:
                lists = {"ids": _matrix(batch, "ids", np.int32), "lower": _matrix(batch, "lower", np.float64)} if near else {"ids": np.zeros((len(x), 0), np.int32), "lower": np.zeros((len(x), 0))}
                state = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "rest")} | lists
                state, went = assigned(x, moved(state, steps), centroids)
            made = [batch.column("vec_id"), batch.column("x"), pa.array(state["cluster"], pa.int32()), pa.array(state["upper"], pa.float64()), _array(state["ids"], pa.int32()), _array(state["lower"], pa.float64()), pa.array(state["rest"], pa.float64()), pa.array(went, pa.int8())]
            yield pa.RecordBatch.from_arrays(made, ["vec_id", "x", "cluster", "upper", "ids", "lower", "rest", "went"])

    return rows.mapInArrow(run, STATE.format(key=rows.schema["vec_id"].dataType.simpleString()))


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after the round: floor(sum / count) per component, exactly; those of empty clusters as they were."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, cluster = _matrix(batch, "x", np.int64), batch.column("cluster").to_numpy(zero_copy_only=False)
                found = np.unique(cluster)
                sums = np.stack([x[cluster == c].sum(axis=0) for c in found])  # a batch's sums fit a long
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.bincount(cluster, minlength=k)[found], pa.int64()), _array(sums, pa.int64())], ["cluster", "n", "sums"])

    parts = state.select("x", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at")
    out = centroids.copy()
    for r in wide.agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect():  # k times the dimensions
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def clustered(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, near: int = NEAR) -> tuple[DataFrame, np.ndarray]:
    """(every vector's state after ``rounds`` rounds of assigning and moving and one last assignment, centroids)."""
    spark = vectors.sparkSession
    folder = f"{checkpoint_dir(spark)}/drake-{uuid.uuid4().hex}"
    scaled(vectors, key=key, vector=vector, dimensions=dimensions, scale=scale).write.parquet(f"{folder}/vectors")
    rows, before = spark.read.parquet(f"{folder}/vectors"), None
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.mapInArrow(lambda batches: iter(()), STATE.format(key=rows.schema["vec_id"].dataType.simpleString())), centroids
    last = f"{folder}/vectors"
    for turn in range(rounds + 1):
        assign(rows, centroids, before, near).write.parquet(f"{folder}/round-{turn}")
        rows = spark.read.parquet(f"{folder}/round-{turn}")
        removed(spark, last)
        last, before = f"{folder}/round-{turn}", centroids
        if turn < rounds:
            centroids = means(rows, centroids)
    return rows, centroids


def clusters(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 per vector, with ``went``: how
    many centroids its last round had to look at (0 none, 1 its own, 2 its near ones, 3 all)."""
    state, centroids = clustered(vectors, **how)
    spark = vectors.sparkSession
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(j, c.tolist(), n) for j, (c, n) in enumerate(zip(centroids, names))], "cluster int, centre array<int>, centroid_sha256 string")  # k rows
    square = F.aggregate(F.zip_with("x", "centre", lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = state.join(F.broadcast(table), "cluster").select("vec_id", "cluster", square.alias("distance"), "centroid_sha256", "went")
    own = {r["cluster"]: int(r["own"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own")).collect()}  # k rows
    sums = spark.createDataFrame([(j, n, sum(own.values())) for j, n in own.items()], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "went")
