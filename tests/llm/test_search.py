import hashlib
import random
import re

from conftest import documents, prose

from confluo.llm import circulant, licenses, secrets, wu_manber


def bench_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(text, items, window=10):
    w = bench_words(text)
    hit, found = set(), set()
    for key, t in items:
        b = bench_words(t)
        m = min(len(b), window)
        if not m:
            continue
        for i in range(len(b) - m + 1):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(key))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()


def test_search_agrees_with_brute_force(shipped, rng, odd, empty):
    items = [(i, prose(rng, rng.choice([2, 5, 9, 10, 11, 25]))) for i in range(12)] + [(3, "a b"), (50, None), (51, ""), (None, "stone bright quick under seven éclair über niño 東京 x1 y2")]
    items += [(60, items[5][1])]  # the same text under two ids
    texts = [prose(rng, 30) for _ in range(30)]
    texts += [t + " " + items[rng.randrange(12)][1] + " " + t for t in texts[:10]] + [items[4][1].upper(), "a b a b", None, ""]
    bench = shipped.createDataFrame(items, "item_id long, text string")
    docs = documents(shipped, texts)
    named = [(k, t) for k, t in items]
    for chars in (1 << 24, 200):  # one block of items, and several
        got = wu_manber.contamination(docs, bench, block_chars=chars).collect()
        for r in got:
            n, hit, found, digest = brute_contamination(texts[r["doc_id"]], named)
            known = [k for k in [x for x in named if x[0] is not None]]
            n2, _, found2, digest2 = brute_contamination(texts[r["doc_id"]], known)
            assert (r["n_words"], r["n_hit"], r["contaminated"]) == (n, hit, hit > 0)
            assert (r["n_items"], r["items_sha256"]) == (found2, digest2)
    clean = wu_manber.decontaminated(docs.withColumn("found", docs.n_chars), bench)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in got if not r["contaminated"]}
    assert clean.columns == [*docs.columns, "found"]
    assert wu_manber.contamination(odd, bench).count() == odd.count()
    assert wu_manber.contamination(empty, bench).count() == 0
    assert wu_manber.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


def shingles(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent=80):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def mutated(rng, words, share):
    return [w if rng.random() > share else rng.choice("zq") + str(rng.randrange(10**6)) for w in words]


def test_groups_agree_with_brute_force(shipped, odd, empty):
    rng = random.Random(8)
    texts = [None, "", " ", "one", "ONE", "one two", "one two"]
    for _ in range(6):  # groups of copies of copies, some too far from each other
        base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.choice([20, 60, 150]))]
        group = [base]
        for _ in range(25):
            group.append(mutated(rng, rng.choice(group), rng.choice([0, 0.02, 0.04, 0.08])))
        texts += [" ".join(g) for g in group]
    shared = " ".join(f"s{i}" for i in range(70))  # a passage that many otherwise different texts hold
    texts += [shared + " " + " ".join(f"u{n}x{i}" for i in range(30)) for n in range(25)]
    rng.shuffle(texts)
    for k in (2, 5):
        got = {r["doc_id"]: r for r in circulant.near_duplicates(documents(shipped, texts), circulant.Similarity(shingle=k)).collect()}
        root, sizes = brute_components(texts, k)
        assert [got[i]["component_id"] for i in range(len(texts))] == root
        assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert all(got[i]["kept"] == (root[i] == i) for i in range(len(texts)))
    out = circulant.near_duplicates(odd.withColumn("band_0", odd.doc_id).withColumn("component", odd.text)).collect()
    assert len(out) == odd.count() and all(r["kept"] for r in out if r["doc_id"] is None)
    assert circulant.near_duplicates(empty).count() == 0


def test_prefix_join_alone_finds_every_link(shipped):
    """Even if the first links are all withheld, the exact step reconnects what a bucket holds."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    texts = [" ".join(mutated(rng, base, 0.04)) for _ in range(40)]
    docs = documents(shipped, texts).select("doc_id", "text")
    of = circulant.Similarity(shingle=2)
    ids = docs.selectExpr("doc_id AS id", "doc_id AS component")
    found = {(r["id"], r["leader"]) for r in circulant.rarest_first(docs, ids, of).collect()}
    sets = [shingles(t, 2) for t in texts]
    for i in range(40):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert (i, j) in found


def test_long_keys_lose_no_link(shipped, monkeypatch):
    """With portions of two, nearly every key is a long one; sizes from 5 to 60 meet at every threshold."""
    monkeypatch.setattr(circulant, "PORTION", 2)
    rng = random.Random(6)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([6, 15, 30, 60]))]
        texts += [" ".join(mutated(rng, base, rng.choice([0, 0.03, 0.06]))[: rng.choice([100, len(base) * 9 // 10])]) for _ in range(20)]
    docs = documents(shipped, texts).select("doc_id", "text")
    for k in (1, 2):
        found = {(r["id"], r["leader"]) for r in circulant.rarest_first(docs, docs.selectExpr("doc_id AS id", "doc_id % 50 AS component"), circulant.Similarity(shingle=k)).collect()}
        sets = [shingles(t, k) for t in texts]
        links = {(i, j) for i in range(len(texts)) for j in range(i) if i % 50 != j % 50 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        assert len(links) > 100 and links <= found


def test_texts_that_share_their_rarest_words_make_few_candidates(shipped):
    """20,000 texts without a link share a passage that is rarer than all else they hold."""
    rng = random.Random(7)
    pool, passage = [f"p{i}" for i in range(80)], " ".join(f"rare{i}" for i in range(10))
    shared = [passage + " " + " ".join(rng.sample(pool, 30)) for _ in range(20_000)]
    others = [" ".join(rng.sample(pool, 60)) for _ in range(20_000)]
    docs = documents(shipped, shared + others + [shared[0]]).select("doc_id", "text")
    ids = docs.selectExpr("doc_id AS id", "CASE WHEN doc_id BETWEEN 20000 AND 39999 THEN -1 ELSE doc_id END AS component")
    found = {(r["id"], r["leader"]) for r in circulant.rarest_first(docs, ids, circulant.Similarity(shingle=1)).collect()}
    assert (40_000, 0) in found and len(found) < 20


def test_components_of_a_long_chain(shipped):
    n = 40
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = shipped.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100)], "id long, leader long")
    got = {r["id"]: r["component"] for r in circulant.components(links).collect()}
    assert {k: v for k, v in got.items() if k < n} == {k: 0 for k in range(1, n)} and got[101] == 100


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_agree_with_brute_force(shipped, rng, odd, empty):
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [f"é {w} password = '{hexes(n)}' {hexes(40)} AKIA{mixed(16).upper()}" for n, w in ((3, "x"), (6, "東京"), (30, "🙂"))]
    texts += ["secret=token: abcdefgh", "token=token=abcdef", "Api_Key:\"abc.def\" api key: nothing", "ſecret=abcdefgh toKen=abcdefgh", "passwd=1passwd=2passwd=345", None, ""]
    texts += [" ".join(mixed(32) for _ in range(6)), "a1" * 30, "0000000000000000000000001", " ".join("x" * 30 + str(i) for i in range(300))]
    texts += [" ".join(f"{hexes(24)}g" for _ in range(400))]
    docs = documents(shipped, texts)
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        base = [s for s in got[i]["spans"].split(",") if s and not s.startswith("random")]
        assert ",".join(base) == want
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(s.startswith(k) for s in base) for k in secrets.KINDS[:3])
    assert got[len(texts) - 5]["n_random"] >= 5  # keys without a pattern
    assert got[len(texts) - 2]["n_random"] == 0 and got[len(texts) - 4]["n_random"] == 0  # repetition isn't random
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs.withColumn("found", docs.text)).collect()}
    assert clean[1].startswith("é 東京 [SECRET]") and clean[len(texts) - 6] == texts[len(texts) - 6]
    assert all(brute_secrets(t) == "" for t in clean.values())
    assert clean[texts.index(None)] is None


def test_least_cut():
    n = secrets.CELLS
    structured = lambda m, cells: [m // cells if c < cells else 0 for c in range(n)]
    both = lambda a, b: [x + y for x, y in zip(a, b)]
    uniform = [50] * n
    assert secrets.least_cut(uniform) == 1 / n
    assert secrets.least_cut([0] * n) == secrets.USUAL_CUT
    assert secrets.least_cut(both(uniform, structured(40_000, 1))) == 1 / n
    wide = secrets.least_cut(both(uniform, structured(20_000, 20)))
    assert 15 / n <= wide <= 20 / n
    # few strings lean on the usual cut, and more of them move it little by little
    by_size = [secrets.least_cut(both([x // 50 * 1 for x in uniform], structured(m, 20))) for m in (0, 40, 400, 4000)]
    assert by_size == sorted(by_size) and by_size[0] <= 2 * secrets.USUAL_CUT


def key(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_p_values_of_random_strings_are_uniform(shipped):
    rng = random.Random(11)
    for name, pattern, alphabet in secrets.ENCODINGS:
        for n in (24, 33, 60):
            rows = [key(rng, alphabet, n) for _ in range(900)]
            rows = [x for x in rows if re.search(secrets.ENCODINGS[[e[0] for e in secrets.ENCODINGS].index(name)][1], x)]
            if name.endswith("26") and n < secrets.LETTERS:
                continue
            ps = sorted(r["p"] for r in secrets.p_values(documents(shipped, [" ".join(rows)])).filter(f"encoding = {[e[0] for e in secrets.ENCODINGS].index(name)}").collect())
            assert len(ps) > 300
            assert max(abs(p - (i + 0.5) / len(ps)) for i, p in enumerate(ps)) < 0.06 + 0.9 / len(ps) ** 0.5, (name, n)


def test_false_discoveries_stay_few_and_keys_are_found(shipped):
    rng = random.Random(12)
    mixed = secrets.UPPER + secrets.LOWER
    keys = [key(rng, mixed + secrets.DIGITS, rng.choice([24, 32, 40])) for _ in range(150)] + [key(rng, mixed, 36) for _ in range(100)] + [key(rng, mixed + secrets.DIGITS + "+/", 42) + "==" for _ in range(100)]
    parts = "get user name list order by count http server value table index record state total".split()
    plain = ["".join(w.title() for w in rng.choices(parts, k=6)) for _ in range(300)] + ["".join(rng.choices(parts, k=5)).title() + "V" + "%09d" % i + "xA" for i in range(300)] + ["item_%020d" % i for i in range(100)]
    texts = [f"see {x} there" for x in keys + plain]
    got = {r["doc_id"]: r for r in secrets.scan(documents(shipped, texts)).collect()}
    found = [i for i in got if got[i]["n_random"]]
    true = sum(i < len(keys) for i in found)
    assert true >= 0.8 * len(keys)
    assert len(found) - true <= 2 * secrets.FDR * len(found)
    # the whole string is the span, padding included
    i = next(i for i in found if keys[i].endswith("=="))
    assert got[i]["spans"] == f"random:4:{4 + len(keys[i])}"


def test_query_finds_planted_keys(shipped, tmp_path):
    from confluo.llm import queries

    rng = random.Random(13)
    texts = ["plain words only"] * 50 + [f"x {key(rng, secrets.UPPER + secrets.LOWER + secrets.DIGITS, 40)} y" for _ in range(50)]
    documents(shipped, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_random"] for r in queries.op3_secret_scans(shipped, str(tmp_path)).collect()}
    assert sum(got[i] for i in range(50)) == 0 and sum(got[i] for i in range(50, 100)) >= 45


HEADERS = {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "ISC Licence"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "The New BSD License"], "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"], "Zlib": ["The zlib License", "zlib License"]}


def test_wrapped_and_titled_licenses(shipped):
    import textwrap

    texts, want = [], []
    for name, text in licenses.KNOWN.items():
        for width in (72, 80):
            for title in ["", *HEADERS.get(name, [])]:
                holder = f"Copyright (c) 2021-2024, Some Body <some@body.org>\nPortions copyright 1999 Others\nAll rights reserved.\r\n\n" if title or width == 72 else ""
                texts.append((title + "\n\n") * bool(title) + holder + textwrap.fill(text, width, initial_indent="  ", break_long_words=False, break_on_hyphens=False))
                want.append(name)
    got = {r["doc_id"]: r["license"] for r in licenses.scan(documents(shipped, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    bullets = licenses.KNOWN["BSD-3-Clause"]
    for n in "123":
        bullets = bullets.replace(f" {n}. ", "\n* ")
    near = [bullets, licenses.KNOWN["MIT"].replace("sell copies", "rent copies"), "Copyright notices matter.\n" + licenses.KNOWN["ISC"]]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(documents(shipped, near)).collect()}
    assert [got[i] for i in range(3)] == ["BSD-3-Clause", None, None]


def test_long_licenses(shipped):
    import os

    import pytest

    folder = "/usr/share/common-licenses"
    files = {n: f"{folder}/{n}" for n in licenses.DIGESTS} | {n: f"{folder}/{n.removesuffix('.0')}" for n in licenses.DIGESTS if n.startswith(("GPL", "LGPL"))} | {"Artistic-1.0": f"{folder}/Artistic"}
    found = {n: f for n, f in files.items() if os.path.exists(f)}
    if not found:
        pytest.skip("no licence texts here")
    texts = [open(f, encoding="utf-8").read() for f in found.values()]
    texts += [re.sub(r"\bLICENSE(S?)\b", r"LICENCE\1", t.replace("\n", "\r\n").upper()) for t in texts]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(documents(shipped, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(found) * 2


def test_licenses(shipped, odd, empty):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n" + mit.upper().replace(", ", " ,\n"), mit.replace("sublicense", "sub-license").replace("License", "Licence"), mit + " extra", "Released under the MIT Licence", None, "", "!!!"]
    got = {r["doc_id"]: r for r in licenses.scan(documents(shipped, texts)).collect()}
    assert [got[i]["license"] for i in range(len(texts))] == ["MIT", "MIT", "MIT", None, "MIT notice", None, None, None]
    assert got[5]["digest"] is None and got[6]["digest"] == got[7]["digest"] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(odd.withColumn("digest", odd.text)).count() == odd.count() and licenses.scan(empty).count() == 0
    keep, licenses.BROADCAST_ROWS = licenses.BROADCAST_ROWS, 0
    try:
        assert licenses.scan(documents(shipped, texts)).filter("license IS NOT NULL").count() == 4
    finally:
        licenses.BROADCAST_ROWS = keep


def test_names_of_holders_spdx_lines_and_organisations(shipped):
    known = licenses.KNOWN
    texts = [
        "MIT License\n\nCopyright Jane Doe\n\n" + known["MIT"],
        "SPDX-License-Identifier: MIT\n\nCopyright (c) Jane Doe and Others <jane@doe.org>\n" + known["MIT"],
        'BSD 3-Clause "New" or "Revised" License\n\nCopyright (c) 2020, Some Body\n' + known["BSD-3-Clause"],
        known["BSD-3-Clause"].replace("the copyright holder nor", "the University of Nowhere, Inc. nor"),
        "Copyright Notice About Nothing At All In This Text, and more\nnot a licence",
        known["BSD-3-Clause"].replace("nor the names of its contributors", "nor anybody"),
    ]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(documents(shipped, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == ["MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", None, None]
