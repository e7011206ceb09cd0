"""Balanced sampling to target weights, against targets and totals worked out by hand."""

import random
import re

import numpy as np
import pytest

from confluo.llm import cube

SCHEMA = "doc_id long, text string, source string, size long, rank int"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(docs):
    """Size and target per source: shares by weight, cut at three times the size, the excess shared again."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + size(text)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weights[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weights[s] / open_ for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return sizes, target
        full |= above


def mix(spark, docs):
    rows = cube.mixed(spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in docs], SCHEMA)).collect()
    assert len(rows) == len(docs)
    return rows


def collection(rng, n, sources):
    return [(i, " ".join(["w"] * max(0, int(rng.lognormvariate(3, 1.2)))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("block", [cube.BLOCK, 200])
def test_sources_come_near_their_targets(shipped, monkeypatch, block):
    monkeypatch.setattr(cube, "BLOCK", block)
    docs = collection(random.Random(1), 4000, ["a", "b", "b", "b", "b", "B", "é", "tiny", None])
    docs = [d for d in docs if d[2] != "tiny"] + [(9000, "one two three", "tiny"), (9001, "four", "tiny")]
    sizes, target = wanted(docs)
    source, texts = {i: s for i, _, s in docs}, {i: t for i, t, _ in docs}
    rows, taken = mix(shipped, docs), {}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size(texts[r.doc_id])
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 5, (s, taken[s], t)
    assert target["tiny"] == 12 and taken["tiny"] == 12
    # the number of documents is balanced too
    for s in ("b", "a"):
        mine = [r for r in rows if source[r.doc_id] == s and r.size]
        assert abs(sum(r.copies for r in mine) - len(mine) * target[s] / sizes[s]) < 25


def test_runs_agree_whatever_the_partitions(shipped):
    docs = collection(random.Random(2), 500, ["x", "y", "z"])
    frame = shipped.createDataFrame([(i, t, s, 1, 2) for i, t, s in docs], SCHEMA)
    once = sorted(tuple(r) for r in cube.mixed(frame.repartition(1)).collect())
    assert once == sorted(tuple(r) for r in cube.mixed(frame.orderBy("text").repartition(7)).collect())


def test_inclusion_follows_the_probabilities():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 400, 300))[::-1].copy()
    share = rng.uniform(0.1, 0.9)
    got = np.zeros(300)
    for _ in range(400):
        out = cube.landing(sizes, cube.flight(sizes, np.full(300, share), rng.random(300)))
        assert set(out) <= {0.0, 1.0}
        assert abs((out * sizes).sum() - share * sizes.sum()) <= 4
        got += out
    # all but the few that the landing decides
    assert (np.abs(got / 400 - share) < 0.12).mean() > 0.85


def test_a_move_keeps_number_and_words():
    rng = random.Random(4)
    for _ in range(500):
        sizes = [rng.choice([1, 2, 50, 50]) for _ in range(3)]
        chances = [rng.uniform(0.01, 0.99) for _ in range(3)]
        moved = cube.step(chances, sizes, rng.random())
        assert any(p in (0, 1) for p in moved) and all(0 <= p <= 1 for p in moved)
        assert sum(moved) == pytest.approx(sum(chances))
        assert sum(p * s for p, s in zip(moved, sizes)) == pytest.approx(sum(p * s for p, s in zip(chances, sizes)))


def test_odd_documents(shipped, odd, empty):
    rows = cube.mixed(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert cube.mixed(empty).collect() == []
    (only,) = mix(shipped, [(1, None, None)])
    assert (only.size, only.source_size, only.target, only.taken) == (0, 0, 0.0, 0)


def test_words_of_long_texts(shipped):
    text = "ab \n" * 1_500_000 + "x" * 3_000_000
    (row,) = mix(shipped, [(1, text, "s")])
    assert row.size == 1_500_001 and row.taken == row.size
