"""Cheapest repairs of conversations against a search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from confluo.llm import repair

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def plain(rows):
    """What the query should return for damaged rows, by trying every edit at every turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, facts, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            facts.append((fault in ("blank", "duplicate"), fault == "truncated"))

        @cache
        def best(i, state, inserts):
            """The least (cost, edits, what is said) from turn i on, after the initials that matter."""
            found = [(0, "", ())] if i == len(mine) and state in ("", "a") else []
            given, name = ("a", "assistant:") if state == "u" else ("u", "user:")
            if inserts:
                cost, edits, said = best(i, given, inserts - 1)
                found.append((cost + 2, "I" + edits, (name, *said)))
            if i < len(mine):
                _, role, text = mine[i]
                must, cut = facts[i]
                cost, edits, said = best(i + 1, state, 3)
                found.append((cost + 3, "D" + edits, said))
                r = role[:1]
                if not must:
                    if (r == "s" and state == "") or (r == "u" and state != "u") or (r == "a" and state == "u"):
                        cost, edits, said = best(i + 1, r, 3)
                        found.append((cost + cut, "K" + edits, (f"{role}:{text}", *said)))
                    cost, edits, said = best(i + 1, given, 3)
                    found.append((cost + 2 + cut, "R" + edits, (name + text, *said)))
            return min(found) if found else (10**9, "", ())

        cost, edits, said = best(0, "", 3)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(spark, rows, damage=True):
    frame = spark.createDataFrame(rows, SCHEMA)
    out = repair.audited(repair.damaged(frame), copies="copies") if damage else repair.audited(frame)
    found = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert out.count() == len(found)
    return found


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def random_turns(rng, conversations, most):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "a? ", "Same.", "x.y"]
    return [(c, rng.choice([t, t, t, rng.randint(0, 5), None]), rng.choice(roles), rng.choice(texts)) for c in range(conversations) for t in range(rng.randint(1, most))]


def test_equals_a_search_over_all_edits(shipped):
    rows = random_turns(random.Random(3), 150, 7)
    want = {c: EMPTY for c in {r[0] for r in rows}} | plain(damaged(rows))
    assert got(shipped, rows) == want


def test_conversations_in_several_partitions(shipped, monkeypatch):
    rng = random.Random(4)
    hot = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{'Said' if rng.random() < 0.9 else rng.choice('ab')} {t if rng.random() < 0.8 else 1}{rng.choice(['.', '.', ''])}") for t in range(600)]
    rows = hot + [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in (1, 2, 8, 9) for t in range(6)] + [(7, 5, "user", "again.")] * 40
    whole = got(shipped, rows, damage=False)
    shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.Repair(repair.faults(shipped.createDataFrame(rows, SCHEMA)))
        assert found.rows.filter("conv = 7").select("share").distinct().count() > 1
        parts = got(shipped, rows, damage=False)
        edits = {}
        for r in sorted(found.turns().collect(), key=lambda r: (r.conv, r.share, r.item)):
            edits.setdefault(r.conv, []).append(r)
    finally:
        shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts == whole
    assert parts == plain(rows)
    for conv, row in parts.items():
        said = "\n".join(f"{r.role}:{r.text}" for r in edits[conv] if r.edit != "D")
        assert hashlib.sha256(said.encode()).hexdigest() == row[-1]
        assert "".join(r.edit + "D" * (r.copies - 1) for r in edits[conv]) == row[-2]


def test_odd_rows(shipped):
    long = "word " * 1_000_000
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (2, 0, "user", ""), (3, 4, "assistant", "Only."), (4, 0, "user", long), (4, 1, "assistant", long + ".")]
    assert got(shipped, rows, damage=False) == plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_empty_table_and_rows_that_are_gone(shipped):
    assert got(shipped, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(shipped, [(gone, 0, "user", "x.")]) == {gone: EMPTY}


def test_names_that_clash(shipped):
    frame = shipped.createDataFrame([("c", 0, "user", "Hi.", 1, 2), ("c", 1, "assistant", "Yes.", 3, 4)], "`a.b` string, n long, role string, text string, conv long, share long")
    (row,) = repair.audited(frame, conv="a.b", turn="n").collect()
    assert (row["a.b"], row.cost, row.audit) == ("c", 0, "KK")


@pytest.mark.parametrize("size", [0, 1, 5])
def test_settled_costs(size):
    import numpy as np

    costs = np.random.default_rng(size).integers(0, 9, (size, 4))
    for before, after in zip(costs.tolist(), repair.settled(costs).tolist()):
        none, system, user, assistant = before
        assert after[2] == min(user, assistant + 2) and after[3] == min(assistant, user + 2)
        assert after[0] == min(none, user + 2, assistant + 4) and after[1] == min(system, user + 2, assistant + 4)
