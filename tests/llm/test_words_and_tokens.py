import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from confluo.llm.arrowtext import fold_table, words
from confluo.llm.tokenizer import WordTokenizer, default_path

RAW = open(default_path(), encoding="utf-8").read()
TOKENIZER = WordTokenizer(RAW)
text = st.text(st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(text, min_size=1, max_size=6))
def test_ids_are_the_librarys(texts):
    offsets, ids = TOKENIZER.batch(pa.array(texts, pa.large_string()), 1)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == TOKENIZER.library.encode(t, add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.text("aAzZéÉßÿ'sS019 \n\t.,!-_<|>", max_size=40))
def test_ids_of_ordinary_text(t):
    _, ids = TOKENIZER.batch(pa.array([t], pa.large_string()))
    assert ids.tolist() == TOKENIZER.library.encode(t, add_special_tokens=False).ids


def test_every_vocabulary_entry_is_reached():
    import json

    from confluo.llm.tokenizer import byte_letters

    letters = byte_letters()
    for token in list(json.loads(RAW)["model"]["vocab"])[::7]:
        body = token.removesuffix("</w>")
        try:
            t = bytes(letters[c] for c in body).decode()
        except (UnicodeDecodeError, KeyError):
            continue
        assert t.split() != [t] or TOKENIZER.chunks([t])[1].tolist() == TOKENIZER.library.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(text, min_size=1, max_size=6))
def test_words_match_their_pattern(texts):
    column = pa.array(texts, pa.large_string())
    for table, pattern in ((None, "[^\x20\x09-\x0d]+"), (fold_table(True), "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        w = words(column, table)
        for i, t in enumerate(texts):
            lower = t if table is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
            assert [w.distinct[c] for c in w.codes[w.offsets[i] : w.offsets[i + 1]]] == re.findall(pattern, lower)
    assert np.all(np.diff(w.offsets) >= 0)


def test_long_texts_are_cut_between_words(monkeypatch):
    import random

    from confluo.llm import arrowtext

    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "é", " ", "\n", "xyz", "東", "\t "]) for _ in range(n)) for n in (0, 1, 50, 400, 3)] + ["w" * 90 + " x", " " * 70, "x" * 200]
    column = pa.array(texts, pa.large_string())
    want = arrowtext.words(column)
    monkeypatch.setattr(arrowtext, "SPAN_BYTES", 16)
    got = arrowtext.words(column)
    assert got.offsets.tolist() == want.offsets.tolist()
    assert [got.distinct[c] for c in got.codes] == [want.distinct[c] for c in want.codes]
