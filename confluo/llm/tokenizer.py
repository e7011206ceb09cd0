"""Subword ids of whole texts, exactly as the public word-level BPE file gives them.

The file's tokens end words, drop white space and never span it, so a text's ids are the ids of its
white-space separated chunks, one after another. Each distinct chunk of a batch is encoded once:
plain chunks all together by byte-pair ranks, with a line end where a piece ends and a space where a chunk
does; anything unusual (characters outside ASCII and Latin letters, special-token strings) by the tokenizers
library itself.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from confluo.llm.arrowtext import Words, ragged, words

#: How the vocabulary file cuts a chunk into pieces, for ASCII and Latin-1 letters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9 ]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
#: What marks the end of a piece, and of a chunk, in the text that is encoded at once; neither occurs in a chunk.
END, GAP = "\n", " "
#: Words whose ids are gathered at once.
IDS_AT_ONCE = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 byte values in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, raw: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw)
        letters = byte_letters()
        ranks = {}
        for token, rank in json.loads(raw)["model"]["vocab"].items():
            body, end = (token[:-4], END.encode()) if token.endswith("</w>") else (token, b"")
            if all(c in letters for c in body) and not token.startswith("<|"):
                ranks[bytes(letters[c] for c in body) + end] = rank
        spare = max(ranks.values()) + 1000
        for i, mark in enumerate((END, GAP)):  # line ends and spaces aren't in the vocabulary's own pieces here
            ranks[mark.encode()] = spare + i
        self.gap = ranks[GAP.encode()]
        self.core = tiktoken.Encoding("words", pat_str=r"[^\n ]+\n| ", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids one after another) of texts without white space."""
        word, mixed, odd = [], [], []
        for i, x in enumerate(texts):
            (word if x.isascii() and x.isalpha() else mixed if PLAIN.match(x) and "<|" not in x else odd).append(i)
        lengths, parts = np.zeros(len(texts), np.int64), []
        for group, line in ((word, (END + GAP).join), (mixed, GAP.join)):
            if not group:
                continue
            text = line([texts[i] for i in group]).lower()
            text = text + END if group is word else PIECES.sub(rf"\g<0>{END}", text)
            ids = np.frombuffer(self.core.encode_to_tiktoken_buffer(text, frozenset()), np.uint32)
            gaps = np.flatnonzero(ids == self.gap)
            lengths[group] = np.diff(gaps, prepend=-1, append=len(ids)) - 1
            parts.append((group, ids[ids != self.gap]))
        if odd:
            each = [self.library.encode(texts[i], add_special_tokens=False).ids for i in odd]
            lengths[odd] = [len(x) for x in each]
            parts.append((odd, np.fromiter(chain.from_iterable(each), np.uint32)))
        flat, begins = np.empty(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        for group, ids in parts:
            flat[ragged(begins[group], lengths[group])] = ids
        return lengths, flat

    def batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids as uint32): text i has ids[offsets[i]:offsets[i + 1]], then ``end`` if given."""
        return self.encoded(words(texts), end)

    def encoded(self, w: Words, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that are cut into words already."""
        lengths, flat = self.chunks(w.distinct)
        if end is not None:
            lengths, flat = np.append(lengths, 1), np.append(flat, np.uint32(end))
        begins = np.cumsum(lengths) - lengths
        codes, offsets = w.codes, w.offsets
        if end is not None:
            codes = np.insert(codes, offsets[1:], len(lengths) - 1)
            offsets = offsets + np.arange(len(offsets))
        sizes = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(int(upto[-1]), np.uint32)
        for a in range(0, len(codes), IDS_AT_ONCE):
            part = slice(a, a + IDS_AT_ONCE)
            ids[upto[a] : upto[min(a + IDS_AT_ONCE, len(codes))]] = flat[ragged(begins[codes[part]], sizes[part])]
        return upto[offsets], ids


_LOADED: dict[int, WordTokenizer] = {}


def loaded(raw: str) -> WordTokenizer:
    """One tokenizer per worker process."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokenizer(raw)
    return _LOADED[key]
