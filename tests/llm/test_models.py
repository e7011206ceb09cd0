import collections
import math
import re
import zlib

import numpy as np
import pytest
from conftest import documents, prose

from confluo.llm import attention_lm, crf, mcd, ordinal

SPACED = "[^\x20\x09-\x0d]+"


def brute_statistics(t):
    w = re.findall(SPACED, t or "")
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if c[(w[i], w[i + 1], w[i + 2])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(SPACED, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_agree_with_brute_force(shipped, rng, odd, empty):
    texts = [prose(rng, rng.choice([0, 2, 3, 60, 300])) for _ in range(30)] + ["a b c a b c", "x x x x", "l\nl\n\nl\n m", "# * | $", None]
    for df, source in ((documents(shipped, texts), dict(enumerate(texts))), (odd, None)):
        source = source or {r["doc_id"]: r["text"] for r in odd.collect()}
        rows = mcd.judged(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = brute_statistics(source[r["doc_id"]])
            assert tuple(r[n] for n in NAMES) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["base_failed"] and r["kept"])
    assert mcd.judged(empty).count() == 0


def test_outliers_of_each_group_go(shipped, rng):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows = []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        odd_one = i % 30 == 0
        rows.append((i, " ".join(x + "###" * odd_one for x in w), "en" if i % 2 else "de", "s"))
    out = mcd.judged(shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    gone = {r["doc_id"] for r in out if not r["kept"]}
    assert gone == {i for i in range(900) if i % 30 == 0}


def fast_mcd(x, floors, rng, starts=200):
    """Location and determinant of the best subset found from many random starts, in numpy."""
    n, d = x.shape
    h = int(np.ceil(mcd.H_SHARE * n))
    scale = mcd.H_SHARE / mcd.chi_square_cdf(mcd.chi_square_quantile(mcd.H_SHARE, d), d + 2)

    def moments(rows):
        m = rows.mean(axis=0)
        c = scale * ((rows[:, :, None] * rows[:, None, :]).mean(axis=0) - np.outer(m, m))
        np.fill_diagonal(c, np.maximum(np.diag(c), floors**2))
        return m, c

    best = None
    for _ in range(starts):
        m, c = moments(x[rng.choice(n, d + 1, replace=False)])
        for _ in range(30):
            r = x - m
            near = np.argsort(np.einsum("ij,jk,ik->i", r, np.linalg.inv(c), r), kind="stable")[:h]
            old, (m, c) = np.linalg.det(c), moments(x[near])
            if np.linalg.det(c) >= old * (1 - 1e-9):
                break
        if best is None or np.linalg.det(c) < best[1]:
            best = m, np.linalg.det(c)
    return best


def test_determinant_is_as_small_as_from_many_random_starts(shipped):
    rng = np.random.default_rng(4)
    floors = np.array(list(mcd.FLOORS.values()))
    rows, want = [], {}
    for lang in "ab":
        for source in "st":
            n = 400
            mix = rng.normal(size=(5, 5)) * floors * 2
            x = rng.normal(size=(n, 5)) @ mix + rng.normal(size=5)
            x[: n // 5] = rng.normal(size=(n // 5, 5)) * 0.3 * floors + 6 * np.abs(mix).sum(axis=0)  # a tight cluster far away
            rows += [(lang, source, *map(float, v)) for v in x]
            want[lang, source] = fast_mcd(x, floors, rng)
    df = shipped.createDataFrame(rows, "lang_ string, source_ string, " + ", ".join(f"{n} double" for n in mcd.NAMES))
    found = {(r["lang_"], r["source_"]): r for r in mcd.smallest_determinants(df).collect()}
    for k, (m, determinant) in want.items():
        assert found[k]["determinant"] <= 1.1 * determinant
        assert np.abs(np.array([found[k][c] for c in mcd.MEANS]) - m).max() < 0.3


def test_small_groups_lean_on_their_parents(shipped):
    rng = np.random.default_rng(6)
    rows = []
    for source, n, at in (("big", 3000, 0.0), ("mid", 200, 3.0), ("small", 5, 3.0)):
        rows += [("a", source, False, *map(float, rng.normal(size=5) + at)) for _ in range(n)]
    df = shipped.createDataFrame(rows, "lang_ string, source_ string, base_failed boolean, " + ", ".join(f"{n} double" for n in mcd.NAMES))
    found = {r["source_"]: r["m_0"] for r in mcd.estimates(df).collect()}
    assert abs(found["big"]) < 0.1 and 2 < found["mid"] < 3 and 0 < found["small"] < 0.6
    salted = mcd.BROADCAST_IDS
    try:
        mcd.BROADCAST_IDS = 0
        again = {r["source_"]: r["m_0"] for r in mcd.estimates(df).collect()}
    finally:
        mcd.BROADCAST_IDS = salted
    assert again == pytest.approx(found)
    assert mcd.estimates(df.limit(0)).count() == 0


def test_chi_square():
    assert mcd.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert mcd.chi_square_cdf(2.0, 2) == pytest.approx(1 - math.exp(-1), abs=1e-9)


def languages(rng, n):
    parts = {"xx": "ka to mi ru ne sho".split(), "yy": "brag stel vorn quil drex".split(), "zz": "éa ouï lè âme çi".split()}
    out = []
    for i in range(n):
        lang = "xx yy zz".split()[i % 3]
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 120))), lang))
    return out, parts


def test_forward_backward_is_exact(rng):
    import itertools

    from confluo.llm.arrowtext import words
    import pyarrow as pa

    rows, parts = languages(rng, 60)
    model = crf.fitted([t for _, t, _ in rows], [x for _, _, x in rows], epochs=1)
    texts = ["kato brag éa", "stel", "", "ouï ka vorn mi"]
    w = words(pa.array(texts, pa.large_string()))
    mean, each = model.marginals(w, keep_words=True)
    emit = model.emissions(w.distinct)
    for i in range(len(texts)):
        codes = w.codes[w.offsets[i] : w.offsets[i + 1]]
        if not len(codes):
            assert (mean[i] == 0).all()
            continue
        total, got = 0.0, np.zeros((len(codes), 3))
        for path in itertools.product(range(3), repeat=len(codes)):
            score = model.first[path[0]] + sum(emit[c, p] for c, p in zip(codes, path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))
            total += math.exp(score)
            for t, p in enumerate(path):
                got[t, p] += math.exp(score)
        np.testing.assert_allclose(each[w.offsets[i] : w.offsets[i + 1]], got / total, atol=1e-4)
        np.testing.assert_allclose(mean[i], (got / total).mean(axis=0), atol=1e-4)


def test_language_id_on_held_out_and_mixed_texts(shipped, rng, odd, empty):
    rows, parts = languages(rng, 400)
    df = shipped.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in crf.identify(df).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, _ in held} == {i for i, r in out.items() if r["held_out"]}
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in held]) > 0.98
    # code-switched words are labelled one by one
    from confluo.llm.arrowtext import words
    import pyarrow as pa

    model = crf.fit(df)
    switch = " ".join(["kato miru torune kashomi"] * 5 + ["bragstel vornquil drexbrag"] * 5)
    w = words(pa.array([switch], pa.large_string()))
    _, each = model.marginals(w, keep_words=True)
    assert [model.langs[k] for k in each.argmax(axis=1)] == ["xx"] * 20 + ["yy"] * 15
    got = {r["doc_id"]: r for r in crf.identify(odd).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[6]["lang_pred"] == "und" and got[0]["score"] == 0
    assert crf.identify(empty).count() == 0
    kept = crf.accepted(df.withColumn("score", df.doc_id).withColumn("row", df.text))
    assert kept.count() == 400 and kept.columns == [*df.columns, "score", "row"]


def test_languages_of_short_or_unspaced_texts_are_learned(shipped, rng):
    rows, _ = languages(rng, 240)
    rows = [(i, " ".join(t.split()[:9]) if lang == "yy" else "".join(rng.choice("東京都大阪府日本語文字") for _ in range(30)) if lang == "zz" else t, lang) for i, t, lang in rows]
    out = {r["doc_id"]: r for r in crf.identify(shipped.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for lang in ("xx", "yy", "zz"):
        assert np.mean([out[i]["lang_pred"] == lang for i, _, x in rows if x == lang and out[i]["held_out"]]) > 0.95
    assert crf.accepted(shipped.createDataFrame(rows, "doc_id long, text string, lang string")).count() > 230


def test_ordinal_grades(shipped, rng, odd, empty):
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(40, 120)).split()
        grade = i % 3
        if grade == 0:
            for _ in range(len(w) // 6):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"])
        if grade == 1:
            w = [x + "$$" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if grade == 1 else 1, 1 if grade == 0 else 0))
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    known = shipped.createDataFrame([x for x in labels if x[0] % 2] + [(10**6, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(docs, known)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in ordinal.rate(docs, model).collect()}
    for grade, kept in ((0, False), (1, False), (2, True)):
        mine = [out[i] for i in range(600) if i % 3 == grade and i % 2 == 0]
        assert np.mean([r["kept"] == kept for r in mine]) > 0.95
    mean = [np.mean([out[i]["expected_grade"] for i in range(600) if i % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert ordinal.rate(odd, model).count() == odd.count() and ordinal.rate(empty, model).count() == 0
    for labels_ in (known.limit(0), known.filter("quality = 1 AND toxic = 0"), known.filter("doc_id = 1000000")):
        assert ordinal.fit(docs, labels_) is None
    assert ordinal.fit(empty, known) is None
    r = ordinal.rate(odd, None).collect()
    assert len(r) == odd.count() and all(x["expected_grade"] is None and x["kept"] is False for x in r)


def test_labels_of_other_documents_dont_use_up_the_sample(shipped):
    docs = shipped.createDataFrame([(i, f"text {i}") for i in range(40)] + [(99, "x" * 30_000)], "doc_id long, text string")
    labels = shipped.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(i, i % 2, 0) for i in range(99, 4000)], "doc_id long, quality int, toxic int")
    texts, grades = ordinal.sample(docs, labels, key="doc_id", text="text", per_grade=20)
    assert len(texts) == 40 and sorted(grades) == [1] * 20 + [2] * 20


def test_cumulative_link_gradients_and_distribution():
    rng = np.random.default_rng(3)
    s, t, k, w = rng.normal(size=9), np.array([-0.4, 0.9]), rng.integers(0, 3, 9), rng.random(9)
    loss, by_score, by_threshold = ordinal.gradients(s, t, k, w)
    e = 1e-6
    for i in range(9):
        d = np.eye(9)[i] * e
        assert (ordinal.gradients(s + d, t, k, w)[0] - ordinal.gradients(s - d, t, k, w)[0]) / (2 * e) == pytest.approx(by_score[i], abs=1e-6)
    for i in range(2):
        d = np.eye(2)[i] * e
        assert (ordinal.gradients(s, t + d, k, w)[0] - ordinal.gradients(s, t - d, k, w)[0]) / (2 * e) == pytest.approx(by_threshold[i], abs=1e-6)
    # by hand: grade probabilities, expected grade and tail
    model = ordinal.CumulativeLink(np.zeros(1), t)
    logistic = lambda x: 1 / (1 + math.exp(-x))
    expected, top = model.rated(s)
    for i in range(9):
        p = [logistic(t[0] - s[i]), logistic(t[1] - s[i]) - logistic(t[0] - s[i]), 1 - logistic(t[1] - s[i])]
        assert (expected[i], top[i]) == pytest.approx((p[1] + 2 * p[2], p[2]))
        assert math.exp(-ordinal.gradients(s[i : i + 1], t, k[i : i + 1], np.ones(1))[0]) == pytest.approx(p[k[i]])


def test_chain_gradients_are_those_of_the_likelihood():
    import itertools

    rng = np.random.default_rng(5)
    e, step, first = rng.normal(size=(3, 4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    gold = np.array([[0, 1, 1, 0], [1, 1, -1, -1], [0, -1, -1, -1]])

    def loss(e, step):
        out = 0.0
        for c in range(3):
            size = int((gold[c] >= 0).sum())
            score = lambda path: first[path[0]] + sum(e[c, t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))
            out += math.log(sum(math.exp(score(path)) for path in itertools.product(range(2), repeat=size))) - score(gold[c][:size].tolist())
        return out

    error, pair = crf.chain_errors(e, step, first, gold)
    for at in np.ndindex(e.shape):
        d = np.zeros_like(e)
        d[at] = 1e-6
        assert (loss(e + d, step) - loss(e - d, step)) / 2e-6 == pytest.approx(error[at], abs=1e-6)
    for at in np.ndindex(step.shape):
        d = np.zeros_like(step)
        d[at] = 1e-6
        assert (loss(e, step + d) - loss(e, step - d)) / 2e-6 == pytest.approx(pair[at], abs=1e-6)


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_base_score_agrees_with_brute_force(shipped, rng, odd, empty, monkeypatch):
    monkeypatch.setattr(attention_lm, "HEAD", 20)
    monkeypatch.setattr(attention_lm, "FIRST_STEPS", 6)
    texts = [prose(rng, rng.randint(0, 90)) + " " + str(rng.randrange(40)) for _ in range(60)] + [None, "", "neverseen neverseen"]
    rows = attention_lm.score(documents(shipped, texts)).collect()
    tokens = {i: re.findall(SPACED, fold(t)) + [""] for i, t in enumerate(texts)}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(x for i, w in tokens.items() if i not in held for x in w)
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(w), sum(c[x] > 0 for x in w), n)
        assert r["score"] < 0
    assert attention_lm.score(odd).count() == odd.count()
    assert attention_lm.score(empty).count() == 0


def test_the_end_is_known_outside_the_head(shipped, monkeypatch):
    monkeypatch.setattr(attention_lm, "most_frequent", lambda counts: {})
    rows = attention_lm.score(documents(shipped, ["a b c"] * 3)).collect()
    assert [r["n_known"] for r in rows] == [4] * 3


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    counts = np.zeros(attention_lm.VOCABULARY, np.int64)
    counts[:3000] = rng.integers(1, 500, 3000)
    c = attention_lm.slots(counts)
    p = attention_lm.fresh()
    # one position after a context: probabilities of all ids sum to 1
    prefix = [5, 9, 700, 20]
    ids = np.concatenate([[*prefix, i] for i in range(attention_lm.VOCABULARY)]).astype(np.int64)
    offsets = np.arange(attention_lm.VOCABULARY + 1) * 5
    first = attention_lm.log_probabilities(p, c, np.array([0, 4]), np.array(prefix))[0]
    total = (10 ** (attention_lm.log_probabilities(p, c, offsets, ids) - first)).sum()
    assert total == pytest.approx(1, abs=1e-3)
    # windows cover each id once and see only what lies before it
    text = rng.integers(0, 3000, 100)
    whole = attention_lm.log_probabilities(p, c, np.array([0, 100]), text)[0]
    parts = [attention_lm.log_probabilities(p, c, np.array([0, k]), text[:k])[0] for k in range(1, 101)]
    assert whole == pytest.approx(parts[-1]) and (np.diff([0, *parts]) < 0).all()
    pattern = np.tile(rng.integers(0, 50, 7), 300)
    x, y = attention_lm.training_windows(c, np.array([0, len(pattern)]), pattern)
    before = attention_lm.log_probabilities(p, c, np.array([0, 210]), pattern[:210])[0]
    attention_lm.train(p, x, y, attention_lm.Adam(0.01), 150)
    assert attention_lm.log_probabilities(p, c, np.array([0, 210]), pattern[:210])[0] > before * 0.6


def test_shape_and_learning_of_ids_with_slots_of_their_own():
    m = attention_lm
    assert (m.WIDTH, m.HIDDEN) == (32, 64)
    counts = np.zeros(m.VOCABULARY, np.int64)
    counts[:1000] = 1000
    c, p, pattern = m.slots(counts), m.fresh(), np.tile([3, 700, 41, 9, 350, 88, 501], 300)
    x, y = m.training_windows(c, np.array([0, len(pattern)]), pattern)
    before = m.log_probabilities(p, c, np.array([0, 210]), pattern[:210])[0]
    m.train(p, x, y, m.Adam(0.004), 150)
    assert m.log_probabilities(p, c, np.array([0, 210]), pattern[:210])[0] > before / 5


def test_every_text_gives_blocks_of_whole_words(rng):
    import pyarrow as pa

    m = attention_lm
    texts = [prose(rng, n) for n in (1, 200, 900, 3000)] + ["w" * 5000, "a" * 800 + " b", " " * 2000 + "x"]
    column, salt = pa.array(["left out", *texts], pa.large_string()).slice(1), np.arange(len(texts)) * 7919
    for share in (1, 2, 32):
        seen = [""] * len(texts)
        for number in range(share):
            out, first, last = m.blocks(column, salt, share, number)
            of = 0
            for t, a, b in zip(out.to_pylist(), first, last):
                while not (t in texts[of] and (not a or texts[of].startswith(t)) and (not b or texts[of].endswith(t))):
                    of += 1
                assert len(t.encode()) < m.BLOCK_BYTES + 6000
                seen[of] += " " + t
        for t, s in zip(texts, seen):
            assert set(re.findall(SPACED, t)) == set(re.findall(SPACED, s)) or not t.strip()
    c = m.slots(np.ones(m.VOCABULARY, np.int64))
    ids = np.arange(100)
    x, y = m.training_windows(c, np.array([0, 100]), ids)
    assert sorted(y[y >= 0]) == sorted(c.of[ids])
    x, y = m.training_windows(c, np.array([0, 60, 100]), ids, np.array([True, False]), np.array([False, True]))
    some = set(y[y >= 0].tolist())
    assert some & set(c.of[60:100]) == set(c.of[100 - len(some & set(c.of[60:100])) : 100]) and c.of[59] not in some
    assert set(c.of[:24]) <= some and len(some & set(c.of[60:100])) >= 40 - 8


def test_rounds_learn_every_id_of_every_text_once(rng):
    m = attention_lm
    c = m.Slots(np.arange(m.VOCABULARY), np.zeros(m.VOCABULARY))
    sizes = [1, 2, 23, 24, 25, 700, 1, 4000]
    offsets, ids = np.concatenate([[0], np.cumsum(sizes)]), np.arange(sum(sizes))
    salt = np.array([rng.randrange(1 << 30) for _ in sizes])
    seen = np.concatenate([y[y >= 0] for y in (m.dealt_windows(c, offsets, ids, salt, k)[1] for k in range(m.ROUNDS))])
    assert sorted(seen.tolist()) == ids.tolist()


def test_a_round_trains_on_the_windows_of_whole_texts(shipped, rng):
    import pyarrow as pa

    m = attention_lm
    texts = [" ".join(rng.choice("kato miru bragstel vorn quil".split()) for _ in range(n)) for n in (3, 400, 2500, 60)] + [""]
    rows = m.salted(documents(shipped, texts).coalesce(1)).collect()
    tokenizer = open(m.default_path(), encoding="utf-8").read()
    offsets, ids = m.loaded(tokenizer).batch(pa.array([r["text"] for r in rows], pa.large_string()), m.END_ID)
    c, start, size = m.slots(np.bincount(ids, minlength=m.VOCABULARY)), m.fresh(), {n: np.full(s, 1e-4, np.float32) for n, s in m.shapes().items()}
    raw = shipped.sparkContext.broadcast(tokenizer)
    got = m.round_(documents(shipped, texts).coalesce(1), raw, shipped.sparkContext.broadcast((c, start, size)), 0)
    want = {n: a.copy() for n, a in start.items()}
    adam = m.Adam(m.RATE / 5, {n: np.zeros_like(a) for n, a in want.items()}, {n: a.copy() for n, a in size.items()}, m.WARM)
    m.train(want, *m.dealt_windows(c, offsets, ids, np.array([r["salt"] for r in rows]), 0), adam, seed=0)
    for n in m.NAMES:
        np.testing.assert_allclose(got[n], want[n], atol=1e-5)


def test_weights_learn_from_every_training_document(shipped, rng, monkeypatch):
    words = [rng.choice("kato miru bragstel vorn quil".split()) for _ in range(40)]
    texts = [" ".join(words * 60) for _ in range(40)]
    df = documents(shipped, texts).coalesce(1)
    seen, kept = [], attention_lm.round_
    monkeypatch.setattr(attention_lm, "round_", lambda *x: seen.append(kept(*x)) or seen[-1])
    rows = attention_lm.score(df).collect()
    assert len(seen) == attention_lm.ROUNDS and all(p is not None for p in seen)
    assert np.mean([r["score"] / r["n_tokens"] for r in rows]) > -1


def test_sections_score_as_a_whole(monkeypatch):
    rng = np.random.default_rng(2)
    m = attention_lm
    c, p = m.slots(rng.integers(1, 500, m.VOCABULARY)), m.fresh()
    sizes = [0, 5, 700, 64, 65, 3]
    offsets, ids = np.concatenate([[0], np.cumsum(sizes)]), rng.integers(0, 5000, sum(sizes))
    whole = m.log_probabilities(p, c, offsets, ids)
    monkeypatch.setattr(m, "SECTION", 64)
    np.testing.assert_allclose(m.log_probabilities(p, c, offsets, ids), whole, rtol=1e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    p = {n: a.astype(np.float64) for n, a in attention_lm.fresh().items()}
    x = rng.integers(0, attention_lm.SLOTS + 1, (2, attention_lm.CONTEXT))
    y = rng.integers(-1, attention_lm.SLOTS, (2, attention_lm.CONTEXT))
    _, d = attention_lm.gradients(p, x, y)
    for n in attention_lm.NAMES:
        at = np.unravel_index(np.abs(d[n]).argmax(), d[n].shape)
        old, losses = p[n][at], []
        for e in (1e-5, -1e-5):
            p[n][at] = old + e
            losses.append(attention_lm.gradients(p, x, y)[0])
        p[n][at] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(d[n][at], rel=1e-3)


def test_gradients_of_a_batch_are_those_of_its_parts_in_memory_used_again():
    rng = np.random.default_rng(3)
    m = attention_lm
    n, p, room = 2 * m.SOME + 5, m.fresh(), m.Room()
    x = np.minimum(rng.zipf(1.3, (n, m.CONTEXT)) - 1, m.SLOTS)
    y = np.minimum(rng.zipf(1.3, (n, m.CONTEXT)) - 1, m.SLOTS) - 1
    m.gradients(p, x[::-1], y[::-1], room)
    loss, got = m.gradients(p, x, y, room)
    parts, weights = [m.gradients(p, x[i : i + 7], y[i : i + 7]) for i in range(0, n, 7)], [(y[i : i + 7] >= 0).sum() / (y >= 0).sum() for i in range(0, n, 7)]
    assert loss == pytest.approx(sum(w * part for (part, _), w in zip(parts, weights)), rel=1e-5)
    for name in m.NAMES:
        np.testing.assert_allclose(got[name], sum(w * d[name] for (_, d), w in zip(parts, weights)), atol=1e-5)


def test_texts_are_encoded_once(shipped, rng, monkeypatch):
    m = attention_lm
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(30)] + [None, "", "É <|ENDOFTEXT|> x"]
    rows = m.encoded(documents(shipped, texts), shipped.sparkContext.broadcast(open(m.default_path(), encoding="utf-8").read())).collect()
    tokenizer = m.loaded(open(m.default_path(), encoding="utf-8").read())
    for r in rows:
        want = tokenizer.library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], np.uint16).tolist() == [*want, m.END_ID]
    monkeypatch.setattr(m, "FIRST_STEPS", 6)
    given, kept = [], m.round_
    monkeypatch.setattr(m, "round_", lambda df, *x: given.append(df.columns) or kept(df, *x))
    assert m.score(documents(shipped, texts)).count() == len(texts)
    assert len(given) == m.ROUNDS and all("ids" in columns and "text" not in columns for columns in given)
