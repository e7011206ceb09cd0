import random
import zlib

import numpy as np
from conftest import prose

from confluo.llm import packing, token_scan
from confluo.llm.tokenizer import WordTokenizer, default_path


def library_ids(texts):
    t = WordTokenizer(open(default_path(), encoding="utf-8").read()).library
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def hold(rows, ids_of, capacity):
    """Every document whole, pieces right, sequences gapless and within capacity."""
    for key, ids in ids_of.items():
        mine = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["piece"])
        assert [r["length"] for r in mine] == [len(ids[a : a + capacity]) for a in range(0, len(ids), capacity)]
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_every_choice_minimises_the_sum_of_squares():
    rng = random.Random(1)
    p = packing.SumOfSquares(20)
    gaps = {}
    for _ in range(400):
        size = rng.randint(1, 20)
        counts = np.bincount([g for g in gaps.values() if g], minlength=21)

        def after(gap):
            c = counts.copy()
            if gap < 20:
                c[gap] -= 1
            if gap - size:
                c[gap - size] += 1
            return int((c * c).sum())

        options = {g for g in gaps.values() if g >= size} | {20}
        number, offset = p.place(size)
        gap = gaps.get(number, 20)
        assert offset == 20 - gap
        assert after(gap) == min(after(g) for g in options)
        gaps[number] = gap - size


def test_packing_is_whole_and_tight(shipped, rng):
    texts = [prose(rng, rng.choice([3, 40, 200, 900])) for _ in range(120)] + [None, "", "x y"]
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (10, 10_000):
        out = packing.pack(packing.tokenized_pieces(df, capacity=512), capacity=512, group_pieces=group).collect()
        ids = dict(enumerate(library_ids(texts)))
        n = hold(out, ids, 512)
        least = -(-sum(map(len, ids.values())) // 512)
        assert n <= least * 1.05 + 2


def test_sequences_hold_the_ids(shipped, rng):
    texts = [prose(rng, 60) for _ in range(20)]
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = packing.pack(packing.tokenized_pieces(df, capacity=256), capacity=256)
    pieces = packing.with_ids(packed, df, capacity=256)
    ids = library_ids(texts)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(pieces).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_ids_of_odd_and_repeated_rows(shipped, odd, empty):
    packed = packing.pack_documents(odd)
    out = packing.with_ids(packed, odd).collect()
    assert len(out) == packed.count()
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert packing.with_ids(packing.pack_documents(empty), empty).count() == 0


def test_a_text_of_20_mb(shipped, rng):
    words = [prose(rng, 1) + str(i) for i in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(2_500_000))
    assert len(text) > 20_000_000
    df = shipped.createDataFrame([(0, "short one"), (1, text)], "doc_id long, text string")
    rows = sorted(packing.pack_documents(df).filter("doc_id = 1").collect(), key=lambda r: r["piece"])
    ids = library_ids([text])[0]
    assert sum(r["length"] for r in rows) == len(ids)
    for r in rows[:: len(rows) // 50]:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_odd_rows(shipped, odd, empty):
    out = packing.pack_documents(odd.withColumn("piece", odd.doc_id)).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in odd.collect()}
    assert sum(r["doc_id"] == 11 for r in out) == 2  # a repeated row is packed twice
    assert next(r["length"] for r in out if r["doc_id"] == 0) == 1
    assert packing.pack_documents(empty).count() == 0


def test_scan_finds_what_the_tokenizer_wrote(shipped, rng, odd, empty):
    texts = [prose(rng, rng.choice([0, 1, 50, 400])) for _ in range(60)]
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_tokens"] for r in token_scan.document_token_counts(df).collect()}
    assert got == {i: len(x) - 1 for i, x in enumerate(library_ids(texts))}
    assert token_scan.document_token_counts(odd).count() == odd.count()
    assert token_scan.document_token_counts(empty).count() == 0


def test_scan_stitches_over_blocks(shipped, tmp_path):
    rng = random.Random(3)
    want = []
    for f in range(3):
        ids = [0 if rng.random() < 0.02 else rng.randint(1, 9) for _ in range(3000 + f)] + [0] * f
        ids[500:1500] = [5] * 1000  # one document over many blocks
        (tmp_path / f"p{f}.tok").write_bytes(np.array(ids, "<u2").tobytes())
        start = 0
        ends = [i for i, x in enumerate(ids) if x == 0]
        for n, e in enumerate(ends):
            want.append((f"p{f}.tok", n, start, e - start, True))
            start = e + 1
        if start < len(ids):
            want.append((f"p{f}.tok", len(ends), start, len(ids) - start, False))
    (tmp_path / "p9.tok").write_bytes(b"")
    keep, token_scan.RUN_BLOCKS = token_scan.RUN_BLOCKS, 4
    try:
        got = token_scan.token_counts(shipped, f"file://{tmp_path}", separator=0, block_tokens=64).collect()
    finally:
        token_scan.RUN_BLOCKS = keep
    assert sorted((r["path"].rsplit("/", 1)[1], r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in got) == sorted(want)
