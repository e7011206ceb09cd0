"""Each stage on its own input against a brute-force version, and the stages together."""

import random
import zlib

import numpy as np
import pytest
from conftest import prose
from test_packing import hold, library_ids
from test_search import brute_components, brute_contamination, brute_secrets

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    parts = {"en": "thing ness able work".split(), "de": "ung keit schön über".split()}
    texts = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        texts.append(("".join(rng.choice(parts[lang]) for _ in range(3)) + " " + " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 80))), lang))
    items = [(i, prose(rng, 15)) for i in range(3)]
    texts += [(t + " extra", lang) for t, lang in texts[:10]] + [(t, lang) for t, lang in texts[10:15]]
    texts += [(texts[20][0] + " " + items[1][1], "en"), (texts[21][0] + " password=abc123def token = 'aaaaaaaaaa'", "en")]
    texts += [(None, "en"), ("", "en"), ("12 34 !!", "de")]
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, now = docs.columns, {r["doc_id"]: r for r in docs.collect()}, docs
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "redact_secrets", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.mode("overwrite").parquet(f"{folder}/out-{name}")
        now = spark.read.parquet(f"{folder}/out-{name}")
        if name == "pack":
            ids = {k: library_ids([r["text"]])[0] for k, r in before.items()}
            rows = now.collect()
            n = hold(rows, ids, 4096)
            assert n <= -(-sum(map(len, ids.values())) // 4096) + 1
            continue
        assert now.columns == columns
        after = {r["doc_id"]: r for r in now.collect()}
        if name == "language_id":
            assert set(before) - set(after) == {k for k, r in before.items() if not any(c.isalpha() for c in r["text"] or "")}
        if name == "near_dedup":
            keys = sorted(before)
            root, _ = brute_components([before[k]["text"] for k in keys], 5)
            assert set(after) == {k for i, k in enumerate(keys) if root[i] == i}
        if name == "decontaminate":
            assert set(after) == {k for k, r in before.items() if not brute_contamination(r["text"], bench)[1]}
        if name == "redact_secrets":
            assert set(after) == set(before)
            for k, r in after.items():
                assert brute_secrets(r["text"]) == "" and r["n_chars"] == len(r["text"])
                assert (r["text"] == before[k]["text"]) == (brute_secrets(before[k]["text"]) == "")
        before = after


def test_run_matches_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.columns[-1] == "ids"
    keep = {r["doc_id"] for r in spark.read.parquet(f"{folder}/out-redact_secrets").collect()}
    assert {r["doc_id"] for r in out.collect()} == keep


def test_stages_take_odd_and_empty_tables(spark, folder, odd, empty):
    clash = odd.withColumn("row", odd.doc_id).withColumn("found", odd.text).withColumn("score", odd.n_chars).withColumn("a.b", odd.doc_id).withColumn("id", odd.lang)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (clash, empty):
            out = stage(spark, docs, folder)
            if name != "pack":
                assert out.columns == docs.columns
            assert out.count() <= max(docs.count() * (2 if name == "pack" else 1), 0)
