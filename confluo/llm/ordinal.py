"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's grade is 0 (toxic), 1 (poor) or 2 (good). One weight vector over hashed text features is
shared by all grades; ordered thresholds turn its score s into P(grade <= k) = logistic(t_k - s),
which gives the expected grade and the probability of the top grade (the tail), by which texts are
selected.

The model is fitted on a bounded sample of labelled rows (SAMPLE_PER_GRADE of each grade, by a hash of
the id, among the documents of 1 to SAMPLE_CHARS characters) and then applied to every whole text where it is read: each
distinct word of a batch is hashed once, and a text's score is a sum over its words.

Defined results: null, empty and blank texts have no features; they get the score 0 and are not kept;
labels without a rating, or of unknown documents, aren't used; contradicting labels of one document
are all used; without labels of two grades there is no model, and score, grade and probability are null and
nothing is kept; repeated rows are rated each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.arrowtext import Words, bounded_batches, slices, words

SAMPLE_PER_GRADE = 2500
SAMPLE_CHARS = 20_000
GRADES = 3
BITS = 18
LEAST_TEXTS = 6
KEEP_TAIL = 0.3


def word_features(word: str) -> tuple[int, int, int]:
    """Slots of a word: the bare word, how it ends, and its shape."""
    bare = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    low = bare.lower()
    rest = word[len(word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) :]
    shape = ("A" if bare.isupper() and len(bare) > 1 else "a" if bare.isalpha() else "0" if bare else "-") + rest[:3]
    mask = (1 << BITS) - 1
    return xxhash.xxh32_intdigest("w" + low) & mask, xxhash.xxh32_intdigest("e" + low[-3:]) & mask, xxhash.xxh32_intdigest("s" + shape) & mask


REPEAT = xxhash.xxh32_intdigest("repeat") & ((1 << BITS) - 1)


def text_features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) of all texts: value is the square root of a slot's share of the words."""
    n = len(w.offsets) - 1
    sizes = np.diff(w.offsets)
    slots = np.array([word_features(x) for x in w.distinct], np.int64).reshape(-1, 3)
    of = np.repeat(np.arange(n), sizes)
    again = np.zeros(len(w.codes), bool)
    again[1:] = (w.codes[1:] == w.codes[:-1]) & (of[1:] == of[:-1])
    keys = np.concatenate([*((of << BITS) + slots[w.codes, k] for k in range(3)), (of[again] << BITS) + REPEAT])
    keys, counts = np.unique(keys, return_counts=True)
    text = keys >> BITS
    return text, keys & ((1 << BITS) - 1), np.sqrt(counts / sizes[text])


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k below the top."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))

    def rated(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the top grade)."""
        below = self.at_most(score)
        return (1 - below).sum(axis=1), 1 - below[:, -1]


def gradients(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log-likelihood of the grades, F(t_k - s) - F(t_{k-1} - s) each, and its gradients by
    score and by threshold."""
    n, i = len(score), np.arange(len(score))
    f = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds[None, :], -40, 40)))
    full = np.concatenate([np.zeros((n, 1)), f, np.ones((n, 1))], axis=1)
    slope = full * (1 - full)
    p = np.maximum(full[i, grades + 1] - full[i, grades], 1e-6)
    by_score = weight * (slope[i, grades + 1] - slope[i, grades]) / p
    by_threshold = np.zeros((n, len(thresholds) + 2))
    by_threshold[i, grades + 1] -= weight * slope[i, grades + 1] / p
    by_threshold[i, grades] += weight * slope[i, grades] / p
    return float(-(weight * np.log(p)).sum()), by_score, by_threshold[:, 1:-1].sum(axis=0)


def fitted(text: np.ndarray, slot: np.ndarray, value: np.ndarray, grades: np.ndarray, *, epochs: int = 30, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> CumulativeLink:
    """Adagrad on the cumulative-link likelihood; texts weigh inversely to their grade's frequency, and
    slots seen in fewer than LEAST_TEXTS texts get no weight."""
    n = len(grades)
    common = np.bincount(slot, minlength=1 << BITS) >= LEAST_TEXTS
    on = common[slot]
    text, slot, value = text[on], slot[on], value[on]
    bounds = np.searchsorted(text, np.arange(n + 1))
    share = np.bincount(grades, minlength=GRADES) / n
    balance = 1 / (np.count_nonzero(share) * np.maximum(share, 1e-9))
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    t, t_seen = np.linspace(-1.0, 1.0, GRADES - 1), np.full(GRADES - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            size = bounds[rows + 1] - bounds[rows]
            index = np.repeat(bounds[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            of = np.repeat(np.arange(len(rows)), size)
            s = np.bincount(of, weights=w[slot[index]] * value[index], minlength=len(rows))
            _, gs, gt = gradients(s, t, grades[rows], balance[grades[rows]] / len(rows))
            touched, where = np.unique(slot[index], return_inverse=True)
            g = np.bincount(where, weights=gs[of] * value[index], minlength=len(touched)) + decay * w[touched]
            seen[touched] += g * g
            w[touched] -= rate * g / np.sqrt(seen[touched])
            t_seen += gt * gt
            t = np.maximum.accumulate(t - rate * 0.1 * gt / np.sqrt(t_seen) + np.arange(GRADES - 1) * 1e-6)
    return CumulativeLink(w.astype(np.float32), t)


def grade(quality, toxic):
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2).cast("int")


def sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, per_grade: int = SAMPLE_PER_GRADE) -> tuple[list[str], np.ndarray]:
    """At most ``per_grade`` rated texts of each grade."""
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
    rated = labels.select(F.col("doc_id").alias("id"), grade(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade IS NOT NULL AND id IS NOT NULL")
    # labels of other documents don't use up the sample
    ranked = rated.join(texts.select("id"), "id", "left_semi").withColumn("h", F.xxhash64("id", F.lit(11)))
    picked = None
    for g in range(GRADES):
        part = ranked.filter(F.col("grade") == g).orderBy("h", "id").limit(per_grade)
        picked = part if picked is None else picked.unionByName(part)
    rows = texts.join(F.broadcast(picked), "id").select("id", "text", "grade").toArrow()
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    return [rows["text"][int(i)].as_py() for i in order], rows["grade"].to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> CumulativeLink | None:
    """The model, or None without labels of two grades."""
    texts, grades = sample(docs, labels, key=key, text=text)
    if len(set(grades.tolist())) < 2:
        return None
    return fitted(*text_features(words(pa.array(texts, pa.large_string()))), grades, **options)


def rate(docs: DataFrame, model: CumulativeLink | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, expected_grade, p_top, kept."""
    spark = docs.sparkSession
    none = F.lit(None).cast("double")
    if model is None:
        return docs.select(F.col(key).cast("long").alias("doc_id"), none.alias("score"), none.alias("expected_grade"), none.alias("p_top"), F.lit(False).alias("kept"))
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                w = words(texts)
                of, slot, value = text_features(w)
                score = np.bincount(of, weights=model.weights[slot] * value, minlength=rows.num_rows)
                expected, top = model.rated(score)
                kept = (top >= KEEP_TAIL) & (np.diff(w.offsets) > 0)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score), pa.array(expected), pa.array(top), pa.array(kept)], ["doc_id", "score", "expected_grade", "p_top", "kept"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, expected_grade double, p_top double, kept boolean")
