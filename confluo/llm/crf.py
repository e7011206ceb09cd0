"""Language ID by a linear-chain conditional random field over the words of a text.

Each word has a hidden language. Emissions come from hashed affixes (2 to 4 characters with the word's
edge), character n-grams inside it and the word itself (a learned lexicon); learned transitions say
how languages follow one another. Forward-backward gives every word's language distribution in its
context, so code-switched texts are labelled word by word; a text's language is the one with the
largest mean, and that mean is its score.

Fitting is by stochastic gradient on the chain likelihood, over a bounded sample of labelled texts
(SAMPLE_PER_LANG of each language, chosen by a hash, SAMPLE_CHARS characters of each at most, fewer where
that many languages would make more than SAMPLE_TOTAL characters): the texts themselves and chains that switch between stretches of different texts, from which transitions
are learned. Prediction streams over all whole texts where they are read; nothing is shuffled.

Defined results: ``und`` with score 0 for a null text or one without a letter; words without letters
take their language from their neighbours; ties go to the alphabetically first language; null labels
aren't learned from; without any label every text is ``und``; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.arrowtext import Words, bounded_batches, bundled, slices, unbundled, words

SAMPLE_PER_LANG = 300
SAMPLE_CHARS, SAMPLE_TOTAL = 20_000, 60_000_000
#: Bytes of text that are labelled at once; features and messages take many times as much memory.
SLICE_BYTES = 4 << 20
#: Different words whose features are held at once.
WORDS_AT_ONCE = 8192
LEAST_SCORE = 0.5
BITS = 17
CHAIN, CHAINS = 48, 64
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = {i: None for i in range(128) if not chr(i).isalpha() and chr(i) != "\n"}


def hashed(*columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), 0x811C9DC5, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of all features, ordered by word."""
    line = "\n" + "\n".join(distinct).lower().translate(NOT_LETTERS) + "\n"
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    edge = c == 10
    word = np.cumsum(edge) - 1  # an edge belongs to the word that it begins
    found = []
    for n in (2, 3, 4):
        if len(c) < n:
            continue
        window = [c[k : len(c) - n + 1 + k] for k in range(n)]
        inner = np.zeros(len(window[0]), bool)
        for k in range(1, n - 1):
            inner |= edge[k : len(c) - n + 1 + k]
        first, last = edge[: len(inner)], edge[n - 1 :]
        ok = ~inner & ~(first & last & (n == 2))
        if n == 4:  # only as an affix
            ok &= first | last
        at = np.flatnonzero(ok)
        found.append((word[at], hashed(np.full(len(at), n, np.uint32), *(x[at] for x in window))))
    # the word itself: a hash over its characters' order-weighted mix
    weight = np.arange(len(c), dtype=np.uint64) - np.flatnonzero(edge).astype(np.uint64)[word] + np.uint64(1)
    mix = (c.astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ weight * np.uint64(0x165667B19E3779F9)
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.add.reduceat(np.where(edge, np.uint64(0), mix), np.flatnonzero(edge))[: len(distinct)]
    found.append((np.flatnonzero(sums), hashed(np.full(np.count_nonzero(sums), 99, np.uint32), sums[sums > 0])))
    of, slot = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(of.astype(np.int32), kind="stable")
    return of[order], slot[order]


@dataclass
class ChainField:
    langs: list[str]
    emit: np.ndarray  # slots x languages
    step: np.ndarray  # from x to, log potentials
    first: np.ndarray

    def emissions(self, distinct: list[str]) -> np.ndarray:
        out = np.zeros((len(distinct), len(self.langs)), np.float32)
        for at in range(0, len(distinct), WORDS_AT_ONCE):
            of, slot = word_features(distinct[at : at + WORDS_AT_ONCE])
            if len(of):
                begins = np.flatnonzero(np.diff(of, prepend=-1))
                out[at + of[begins]] = np.add.reduceat(self.emit[slot], begins, axis=0)
        return out

    def marginals(self, w: Words, keep_words: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Mean language distribution of each text, and each word's if asked for. All texts advance
        together, longest first, so a step is one small matrix product over those not yet at their end."""
        k, n = len(self.langs), len(w.offsets) - 1
        e = self.emissions(w.distinct)
        potential = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
        size = np.diff(w.offsets)
        order = np.argsort(-size, kind="stable")
        start, size_, live = w.offsets[:-1][order], size[order], np.zeros(0, np.int64)
        longest = int(size_[0]) if n else 0
        live = np.searchsorted(-size_, -np.arange(longest), side="left")  # texts longer than t
        codes = w.codes
        alpha = np.empty((len(codes), k), np.float32)
        step, first = np.exp(self.step).astype(np.float32), np.exp(self.first).astype(np.float32)
        a = np.zeros((n, k), np.float32)
        for t in range(longest):
            m = live[t]
            at = start[:m] + t
            a = (first[None, :] if t == 0 else a[:m] @ step) * potential[codes[at]]
            a /= a.sum(axis=1, keepdims=True)
            alpha[at] = a
        total = np.zeros((n, k))
        each = np.empty((len(codes), k), np.float32) if keep_words else None
        b = np.ones((n, k), np.float32)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            at = start[:m] + t
            g = alpha[at] * b[:m]
            g /= g.sum(axis=1, keepdims=True)
            total[:m] += g
            if each is not None:
                each[at] = g
            back = (b[:m] * potential[codes[at]]) @ step.T
            b[:m] = back / back.sum(axis=1, keepdims=True)
        out = np.zeros((n, k))
        out[order] = total / np.maximum(size_, 1)[:, None]
        return out, each


def chains(texts: Words, labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(word codes, labels), both chains x CHAIN: half from single texts, half switching between texts. Short
    texts and tails make chains too; places after their end have label -1 and repeat their words."""
    w = texts
    size = np.diff(w.offsets)
    piece = [(i, a) for i in range(len(size)) for a in range(0, int(size[i]), CHAIN)]
    if not piece:
        return np.zeros((0, CHAIN), np.int64), np.zeros((0, CHAIN), np.int64)
    of, begin = np.array(piece, np.int64).T
    length = np.minimum(size[of] - begin, CHAIN)[:, None]
    single = (w.offsets[of] + begin)[:, None] + np.arange(CHAIN) % length
    lang = np.repeat(labels[of][:, None], CHAIN, axis=1)
    y = np.where(np.arange(CHAIN) < length, lang, -1)
    # switching: stretches of random length taken from random chains
    n = len(single)
    cut = rng.random((n, CHAIN)) < 1 / 12
    cut[:, 0] = True
    turn = np.maximum.accumulate(np.where(cut, np.arange(CHAIN), 0), axis=1)
    source = rng.integers(0, n, (n, CHAIN))[np.arange(n)[:, None], turn]
    mixed, mixed_y = single[source, np.arange(CHAIN)], lang[source, np.arange(CHAIN)]
    return w.codes[np.concatenate([single, mixed])].astype(np.int64), np.concatenate([y, mixed_y])


def chain_errors(e: np.ndarray, step: np.ndarray, first: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected less real labels of each place (chains x places x languages) and pair of neighbours (languages x
    languages, of all chains): the gradients of the negative log-likelihood by emission and by transition. ``e``
    are log potentials; places of label -1, at the ends of chains, don't count."""
    n, length, k = e.shape
    real = gold >= 0
    p = np.exp(e - e.max(axis=2, keepdims=True))
    step, first = np.exp(step), np.exp(first)
    alpha, beta = np.empty((length, n, k)), np.ones((length, n, k))
    for t in range(length):
        a = (first[None, :] if t == 0 else alpha[t - 1] @ step) * p[:, t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    pair = np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        into = beta[t] * p[:, t]
        b = into @ step.T
        joint = alpha[t - 1][:, :, None] * step[None] * into[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True))[real[:, t]].sum(axis=0)
        beta[t - 1] = np.where(real[:, t, None], b / b.sum(axis=1, keepdims=True), 1)
    g = alpha * beta
    g /= g.sum(axis=2, keepdims=True)
    error = g.transpose(1, 0, 2).copy()
    error[~real] = 0
    row, at = np.nonzero(real)
    error[row, at, gold[real]] -= 1
    np.subtract.at(pair, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    return error, pair


def fitted(texts: list[str], labels: list[str], *, epochs: int = 3, rate: float = 0.3, decay: float = 1e-6, seed: int = 3) -> ChainField:
    langs = sorted(set(labels))
    k = len(langs)
    w = words(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(seed)
    y_text = np.array([langs.index(x) for x in labels], np.int64)
    x, y = chains(w, y_text, rng)
    of, slot = word_features(w.distinct)
    bounds = np.searchsorted(of, np.arange(len(w.distinct) + 1))
    model = ChainField(langs, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    seen = np.full((1 << BITS, k), 1e-4, np.float32)
    step_seen, first_seen = np.full((k, k), 1e-4), np.full(k, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), CHAINS):
            codes, gold = x[order[i : i + CHAINS]], y[order[i : i + CHAINS]]
            n = len(codes)
            used, where = np.unique(codes, return_inverse=True)
            where = where.reshape(codes.shape)
            sizes = bounds[used + 1] - bounds[used]
            index = np.repeat(bounds[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            owner, slots = np.repeat(np.arange(len(used)), sizes), slot[index]
            e = np.stack([np.bincount(owner, weights=model.emit[slots, j], minlength=len(used)) for j in range(k)], axis=1)
            error, pair = chain_errors(e[where], model.step, model.first, gold)
            pair /= n
            by_word = np.stack([np.bincount(where.ravel(), weights=error[:, :, j].ravel(), minlength=len(used)) for j in range(k)], axis=1)
            touched, at = np.unique(slots, return_inverse=True)
            grad = np.stack([np.bincount(at, weights=by_word[owner, j], minlength=len(touched)) for j in range(k)], axis=1) / n + decay * model.emit[touched]
            seen[touched] += grad * grad
            model.emit[touched] -= rate * grad / np.sqrt(seen[touched])
            step_seen += pair * pair
            model.step -= 0.1 * pair / np.sqrt(step_seen)
            start = error[:, 0].mean(axis=0)
            first_seen += start * start
            model.first -= 0.1 * start / np.sqrt(first_seen)
    return model


def trained_on(key: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text, modulo 4, isn't 2."""
    return F.crc32(key.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> ChainField | None:
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.coalesce(trained_on(F.col("id")), F.lit(True)) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # one scan: a hash below each language's share picks a little more than the sample, which is then cut to size
    most = per_lang + 6 * per_lang**0.5 + 20
    below = F.create_map(*(x for name, n in sorted(sizes.items()) for x in (F.lit(name), F.lit(int(min(1.0, most / n) * (1 << 30))))))
    chars = max(1, min(SAMPLE_CHARS, SAMPLE_TOTAL // (per_lang * len(sizes))))
    h = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    picked = sorted((r["lang"], r["h"], r["id"] or 0, r["text"]) for r in rows.withColumn("h", h).filter(h < below[F.col("lang")]).withColumn("text", F.substring("text", 1, chars)).collect())
    seen: dict[str, int] = {}
    found = []
    for name, _, _, t in picked:
        seen[name] = seen.get(name, 0) + 1
        if seen[name] <= per_lang:
            found.append((name, 0, t))
    return fitted([t for _, _, t in found], [n for n, _, _ in found])


def predicted(rows: DataFrame, model: ChainField | None) -> DataFrame:
    """(text, row) with lang_pred and score added."""
    spark = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                w = words(texts)
                n = part.num_rows
                lettered = np.fromiter((LETTER.search(x) is not None for x in w.distinct), bool, len(w.distinct))
                has = np.concatenate([[0], np.cumsum(lettered[w.codes])]) if len(w.codes) else np.zeros(1, np.int64)
                has = has[w.offsets[1:]] > has[w.offsets[:-1]]
                if model is None:
                    names, score = ["und"] * n, np.zeros(n)
                else:
                    mean, _ = model.marginals(w)
                    best = mean.argmax(axis=1)
                    names = [model.langs[b] if ok else "und" for b, ok in zip(best, has)]
                    score = np.where(has, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double")


def identify(docs: DataFrame, *, key: str = "doc_id", **names) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    text = names.get("text", "text")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = predicted(rows, fit(docs, key=key, **names))
    return out.select("doc_id", F.coalesce(~trained_on(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, *, least: float = LEAST_SCORE, text: str = "text", **names) -> DataFrame:
    """The documents with a language of at least ``least`` on average, with the columns they came with."""
    out = predicted(bundled(docs, text), fit(docs, text=text, **names))
    return unbundled(out.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs.columns, text)
