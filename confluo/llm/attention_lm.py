"""Scoring texts with a small causal self-attention model over subword ids, trained in numpy.

Vocabulary: the subword ids of the public tokenizer. The SLOTS - 1 = 4,095 most frequent ids of the training
corpus have slots of their own, and the rest share the last one by their corpus shares. The model predicts
the next slot in LEVELS steps down a tree of BRANCH-fold nodes, so every id has a probability and each soft-max
stays small.

Training covers the corpus in two stages. Counts, of words for the base score and of ids for the slots,
are taken over every training document. The weights start from a bounded sample in one task, and then learn
from every id of every training document in ROUNDS rounds of local updates: the windows of each text, which hold
each of its ids and its end once, are dealt to the rounds in turn, every partition trains on its windows of the
round from the same weights, and the weights are averaged by the number of windows. The driver only ever holds
one model.

Texts are encoded once: their ids, two bytes each, are saved for the rounds and for scoring.

Scoring: a text's ids are cut into overlapping windows of CONTEXT ids, of which the last STRIDE are scored;
the first window begins before the text. So each id is scored once, with CONTEXT - STRIDE ids before it
at least, by batched masked attention. Long texts are scored in sections, which see the ids before them.

The base score needs the count of each token of each text. The HEAD most frequent tokens are a bounded
table in every worker; a text's other tokens meet the table of all counts in a join.

Defined results: null counts as empty, which is one token, the end; repeated rows are scored each on
their own; a null id isn't held out; without training texts all counts are 0 and the model is as
initialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.arrowtext import SPACES, bounded_batches, fold_table, ragged, slices, words
from confluo.llm.jobs import saved
from confluo.llm.tokenizer import default_path, loaded

#: The model's shape.
BRANCH, LEVELS, WIDTH, HIDDEN, CONTEXT, STRIDE = 16, 3, 32, 64, 24, 16
SLOTS, BEFORE = BRANCH**LEVELS, CONTEXT - STRIDE
VOCABULARY, END_ID = 49_408, 49_407
#: The first sample: about so many documents, blocks of each at most, bytes of a block, steps.
SAMPLE, SAMPLE_BLOCKS, SAMPLE_BYTES, FIRST_STEPS = 1500, 12, 768, 700
#: Rounds that share out all windows, bytes of a block of the first sample by default, windows that are mixed.
ROUNDS, BLOCK_BYTES, MIXED = 2, 96, 16_384
#: Windows in a batch, rate of learning at first.
BATCH, RATE = 256, 0.016
#: Runs of fewer rows are summed place by place; numbers that Adam updates at once; windows
#: whose attention is worked on at once.
SHORT, PIECE, SOME = 8, 1 << 15, 128
#: Steps after which Adam's averages need no correction.
WARM = 10_000
#: Weights that travel together; ids that are scored at once.
CHUNK, SECTION = 4096, 1 << 20
#: Bytes of text whose words are looked up at once in scoring.
SCORED_BYTES = 4 << 20
#: Most frequent words that every worker knows.
HEAD = 200_000
def nodes(level: int) -> str:
    """Name of the weights of all nodes of a level, which are (nodes, WIDTH + 1, BRANCH): the last row is the bias."""
    return f"tree_{level}"


def shapes() -> dict[str, tuple[int, ...]]:
    square = {n: (WIDTH, WIDTH) for n in ("query", "key", "value", "out")}
    return {"embed": (SLOTS + 1, WIDTH), "place": (CONTEXT, WIDTH), **square, "up": (WIDTH + 1, HIDDEN), "down": (HIDDEN, WIDTH), **{nodes(k): (BRANCH**k, WIDTH + 1, BRANCH) for k in range(LEVELS)}}


NAMES = tuple(shapes())


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "place": 0.1, "down": 0.7 / np.sqrt(HIDDEN), "up": 0.7 / np.sqrt(WIDTH)} | {n: 0.7 / np.sqrt(WIDTH) for n in ("query", "key", "value", "out")}
    p = {n: rng.normal(0, scale.get(n, 0.1), s).astype(np.float32) for n, s in shapes().items()}
    p["up"][-1] = 0
    for k in range(LEVELS):
        p[nodes(k)][:, -1] = 0
    return p


LARGEST = 30.0
MASK = np.where(np.arange(CONTEXT)[:, None] < np.arange(CONTEXT)[None, :], -1e9, 0).astype(np.float32)


def biased(a: np.ndarray) -> np.ndarray:
    """With a last column of ones, which makes the last row of weights a bias."""
    out = np.empty((*a.shape[:-1], a.shape[-1] + 1), a.dtype)
    out[..., :-1] = a
    out[..., -1] = 1
    return out


class Room:
    """Arrays by name that are used again, as fresh memory costs about what is computed in it."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, a = int(np.prod(shape)), self.kept.get(name)
        if a is None or a.size < size or a.dtype != kind:
            a = self.kept[name] = np.empty(size, kind)
        return a[:size].reshape(shape)

    def zeros(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        a = self(name, shape, kind)
        a.fill(0)
        return a


def soft(z: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of columns of logits: exp less each one's largest, in place, the sums of these, and the logarithm of
    the soft-max at the row ``picked`` of each, which doesn't get too small for a float."""
    z -= z.max(axis=0)
    at = z[picked, np.arange(z.shape[1])]
    np.exp(z, out=z)
    sums = z.sum(axis=0)
    return z, sums, at - np.log(sums)


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, sizes) of the runs of equal values."""
    begins = np.flatnonzero(np.diff(sorted_, prepend=sorted_.dtype.type(-1)))
    return begins, np.diff(begins, append=len(sorted_))


def upper(p: dict[str, np.ndarray]) -> np.ndarray:
    """Weights of all levels but the last on the way to each node above the last level, side by side."""
    above = np.arange(BRANCH ** (LEVELS - 2))
    return np.concatenate([p[nodes(k)][above // BRANCH ** (LEVELS - 2 - k)] for k in range(LEVELS - 1)], axis=2)


def ways(slot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Of sorted slots, for ``upper`` and for the last level: (nodes met, begins, sizes, (node, from, to) of each)."""
    found = []
    for width in (BRANCH**2, BRANCH):
        of = slot // width
        begins, sizes = runs(of)
        met = of[begins].astype(np.intp)
        found.append((met, begins, sizes, list(zip(met.tolist(), begins.tolist(), (begins + sizes).tolist()))))
    return found


def branches(above: np.ndarray, last: np.ndarray, rows: np.ndarray, way: list, room: Room) -> np.ndarray:
    """Logits of the branches of the nodes on each row's way, a column per row: (LEVELS, BRANCH, rows)."""
    z, turned = room("logits", (LEVELS * BRANCH, len(rows)), rows.dtype), rows.T
    cut = (LEVELS - 1) * BRANCH
    for weights, out, (*_, each) in zip((above, last), (z[:cut], z[cut:]), way):
        for node, a, b in each:
            np.matmul(weights[node].T, turned[:, a:b], out=out[:, a:b])
    return z.reshape(LEVELS, BRANCH, -1)


def steps(slot: np.ndarray) -> np.ndarray:
    """The branch that leads to each slot, level by level: (LEVELS, rows)."""
    return np.stack([slot // BRANCH ** (LEVELS - 1 - k) % BRANCH for k in range(LEVELS)]).astype(np.intp)


def tree_gradients(p: dict[str, np.ndarray], rows: np.ndarray, slot: np.ndarray, d: dict[str, np.ndarray], room: Room) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of the slots, which are sorted, and what flows back to the rows; the nodes' gradients go to ``d``."""
    way, above, last, kind = ways(slot), upper(p), p[nodes(LEVELS - 1)], rows.dtype
    z, at = branches(above, last, rows, way, room), np.arange(len(rows))
    loss, share = 0.0, kind.type(1 / max(1, len(rows)))
    for e, branch in zip(z, steps(slot)):
        _, total, chance = soft(e, branch)
        loss -= chance.sum()
        e *= share / total
        e[branch, at] -= share
    z, cut = z.reshape(LEVELS * BRANCH, -1), (LEVELS - 1) * BRANCH
    back, more = (room(name, (len(rows), WIDTH), kind) for name in ("back", "more"))
    grown = room.zeros("above", above.shape, kind), room.zeros("last", last.shape, kind)
    for weights, e, grad, out, (*_, each) in zip((above, last), (z[:cut], z[cut:]), grown, (back, more), way):
        for node, a, b in each:
            np.matmul(rows[a:b].T, e[:, a:b].T, out=grad[node])
            np.matmul(e[:, a:b].T, weights[node, :-1].T, out=out[a:b])  # nothing flows into the ones
    back += more
    for k in range(LEVELS - 1):
        d[nodes(k)] = grown[0][..., k * BRANCH : (k + 1) * BRANCH].reshape(BRANCH**k, -1, WIDTH + 1, BRANCH).sum(axis=1)
    d[nodes(LEVELS - 1)] = grown[1]
    return float(loss * share), back


def summed(rows: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows; long runs by products with ones, short ones place by place."""
    out, few = np.empty((len(begins), rows.shape[1]), rows.dtype), sizes < SHORT
    ones = np.ones((1, int(sizes.max(initial=0))), rows.dtype)
    for i in np.flatnonzero(~few).tolist():
        a, n = begins[i], sizes[i]
        np.matmul(ones[:, :n], rows[a : a + n], out=out[i : i + 1])
    first, left = begins[few], sizes[few]
    short = rows.take(first, axis=0)
    for k in range(1, SHORT):
        on = np.flatnonzero(left > k)
        if not len(on):
            break
        short[on] += rows.take(first[on] + k, axis=0)
    out[few] = short
    return out


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, wanted: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the places that want a slot (not -1), and its gradient, which is in ``room``. Queries,
    keys and values (these times ``out`` already) are linear in slot and place: they are multiplied out for each
    slot and place once, and so is what flows back to them, summed by slot and by place. Below the tree, a few
    windows at a time are worked on, whose numbers stay in the cache."""
    room = room or Room()
    n, m = inputs.shape
    used = np.flatnonzero(np.bincount(inputs.ravel(), minlength=SLOTS + 1))
    code = np.empty(SLOTS + 1, np.int16)  # numpy sorts 16 bits by radix
    code[used] = np.arange(len(used))
    entered, want = code[inputs], wanted.ravel().astype(np.int16)
    embed, place, kind = p["embed"][used], p["place"], p["embed"].dtype
    scale = kind.type(1 / np.sqrt(WIDTH))
    looked = np.concatenate([p["query"] * scale, p["key"], p["value"] @ p["out"]], axis=1)
    of_slot, of_place = (np.concatenate([a @ looked, a], axis=1) for a in (embed, place))
    part = lambda a: tuple(a[..., i * WIDTH : (i + 1) * WIDTH] for i in range(4))
    parts, held = [slice(i, min(i + SOME, n)) for i in range(0, n, SOME)], []
    g = room("g", (n * m, WIDTH + 1), kind)
    g[:, -1] = 1
    for some in parts:
        size, name = (some.stop - some.start) * m, str(some.start)
        seen, s, h = (room(x + name, (size // m, m, w), kind) for x, w in (("seen", 4 * WIDTH), ("s", m), ("h", WIDTH + 1)))
        r, active = room("r" + name, (size, HIDDEN), kind), room("active" + name, (size, HIDDEN), np.dtype(bool))
        of_slot.take(entered[some], axis=0, mode="clip", out=seen)
        seen += of_place
        q, k, v, x = part(seen)
        np.matmul(q, k.transpose(0, 2, 1), out=s)
        s += MASK
        np.exp(np.minimum(s, LARGEST, out=s), out=s)  # bounded scores need no maximum
        s /= s @ np.ones((m, 1), kind)
        h[..., -1] = 1  # makes the last row of weights a bias
        np.matmul(s, v, out=h[..., :-1])
        h[..., :-1] += x
        h = h.reshape(size, -1)
        np.matmul(h, p["up"], out=r)
        np.greater(r, 0, out=active)
        r *= active
        np.add(h[:, :-1], np.matmul(r, p["down"], out=room("down", (size, WIDTH), kind)), out=g[some.start * m : some.stop * m, :-1])
        held.append((seen, s, h, r, active))

    d, on = {}, np.flatnonzero(want >= 0)
    on = on[np.argsort(want[on], kind="stable")]
    loss, back = tree_gradients(p, g.take(on, axis=0, mode="clip", out=room("rows", (len(on), WIDTH + 1), kind)), want[on], d, room)
    flown = room.zeros("flown", (n * m, WIDTH), kind)
    flown[on] = back

    d |= {name: room.zeros("d" + name, p[name].shape, kind) for name in ("embed", "up", "down")}
    at_slot, at_place, turned = room.zeros("slots", of_slot.shape, kind), np.zeros_like(of_place), np.ascontiguousarray(p["up"][:-1].T)
    for some, (seen, s, h, r, active) in zip(parts, held):
        q, k, v, _ = part(seen)
        dg = flown[some.start * m : some.stop * m]
        d["down"] += r.T @ dg
        du = np.matmul(dg, p["down"].T, out=room("du", r.shape, kind))
        du *= active
        d["up"] += h.T @ du
        dg += np.matmul(du, turned, out=room("down", dg.shape, kind))
        flow, dh = room("flow", seen.shape, kind), dg.reshape(-1, m, WIDTH)
        dq, dk, dv, dx = part(flow)
        dx[:] = dh
        ds = np.matmul(dh, v.transpose(0, 2, 1), out=room("ds", s.shape, kind))
        ds -= np.einsum("nij,nij->ni", ds, s)[..., None]
        ds *= s
        np.matmul(ds, k, out=dq)
        np.matmul(ds.transpose(0, 2, 1), q, out=dk)
        np.matmul(s.transpose(0, 2, 1), dh, out=dv)
        at_place += flow.sum(axis=0)
        slot = entered[some].ravel()
        by_slot = np.argsort(slot, kind="stable")
        slot = slot[by_slot]
        begins, sizes = runs(slot)
        at_slot[slot[begins]] += summed(flow.reshape(-1, 4 * WIDTH).take(by_slot, axis=0, mode="clip", out=room("sorted", (len(slot), 4 * WIDTH), kind)), begins, sizes)
    cut = 3 * WIDTH
    d["place"] = at_place[:, cut:] + at_place[:, :cut] @ looked.T
    d["embed"][used] = at_slot[:, cut:] + at_slot[:, :cut] @ looked.T
    into = embed.T @ at_slot[:, :cut] + place.T @ at_place[:, :cut]
    d["query"], d["key"], both = into[:, :WIDTH] * scale, into[:, WIDTH : 2 * WIDTH], into[:, 2 * WIDTH :]
    d["value"], d["out"] = both @ p["out"].T, p["value"].T @ both
    return loss, d


@dataclass
class Adam:
    rate: float
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)
    steps: int = 0

    def update(self, p: dict[str, np.ndarray], d: dict[str, np.ndarray]) -> None:
        """One step, in place."""
        self.steps += 1
        decay, slower = 1 / np.sqrt(1 - 0.98**self.steps), self.rate / (1 - 0.9**self.steps)
        room = np.empty(PIECE, np.float32)
        for n, g in d.items():
            if n not in self.first:
                self.first[n], self.second[n] = np.zeros_like(p[n]), np.zeros_like(p[n])
            flat = [x.reshape(-1) for x in (p[n], self.first[n], self.second[n], np.ascontiguousarray(g))]
            for i in range(0, g.size, PIECE):
                w, a, b, now = (x[i : i + PIECE] for x in flat)
                t = room[: len(w)]
                a *= 0.9
                a += np.multiply(now, np.float32(0.1), out=t)
                b *= 0.98
                np.square(now, out=t)
                t *= np.float32(0.02)
                b += t
                np.sqrt(b, out=t)
                t *= np.float32(decay)
                t += np.float32(1e-8)
                np.divide(a, t, out=t)
                t *= np.float32(slower)
                w -= t


@dataclass
class Slots:
    """Slot of each id, and log10 of the id's share of its slot."""

    of: np.ndarray
    share: np.ndarray


def slots(counts: np.ndarray) -> Slots:
    order = np.argsort(-counts, kind="stable")
    of = np.full(VOCABULARY, SLOTS - 1, np.int64)
    of[order[: SLOTS - 1]] = np.arange(SLOTS - 1)
    total = np.bincount(of, weights=counts + 1.0, minlength=SLOTS)
    return Slots(of, np.log10((counts + 1.0) / total[of]))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first scored id) of the windows that score every id once."""
    each = -(-sizes // STRIDE)
    return np.repeat(np.arange(len(sizes)), each), ragged(np.zeros(len(sizes), np.int64), each) * STRIDE


def inputs_at(slotted: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and wanted slots of windows whose scored part begins at the id ``at`` (absolute); ids before
    their text, and the one that predicts its first id, are the extra input. Wanted is -1 outside."""
    place = at[:, None] + np.arange(CONTEXT) - BEFORE
    inside = (place >= starts[:, None]) & (place < ends[:, None])
    before = (place - 1 >= starts[:, None]) & (place - 1 < ends[:, None])
    last = len(slotted) - 1
    x = np.where(before, slotted[np.clip(place - 1, 0, last)], SLOTS)
    return x, np.where(inside, slotted[np.clip(place, 0, last)], -1)


def sections(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of stretches of at most SECTION ids, windows whole."""
    sizes = np.diff(offsets)
    each = np.maximum(-(-sizes // SECTION), 1)
    of = np.repeat(np.arange(len(sizes)), each)
    begin = offsets[of] + ragged(np.zeros(len(sizes), np.int64), each) * SECTION
    return of, begin, np.minimum(begin + SECTION, offsets[of + 1])


def log_probabilities(p: dict[str, np.ndarray], c: Slots, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log10 probability of each text, the sum over all its ids."""
    of, begin, end = sections(offsets)
    total, at = np.zeros(len(offsets) - 1), 0
    upto = np.cumsum(end - begin)
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SECTION, side="right")))
        total += np.bincount(of[at:to], weights=section_scores(p, c, offsets[of[at:to]], begin[at:to], end[at:to], ids), minlength=len(total))
        at = to
    return total


def section_scores(p: dict[str, np.ndarray], c: Slots, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, batch: int = 512) -> np.ndarray:
    """log10 probability of the ids from begin to end of texts that start at ``starts``. One layer lets queries,
    keys and values be looked up per slot and per place instead of multiplied out; otherwise this is what ``gradients`` has."""
    scale, mix = np.float32(1 / np.sqrt(WIDTH)), p["value"] @ p["out"]
    looked = [(p["embed"] @ w, p["place"][a:] @ w) for w, a in ((p["query"] * scale, BEFORE), (p["key"], 0), (mix, 0))]
    (q_slot, q_place), (k_slot, k_place), (v_slot, v_place) = looked
    sizes = end - begin
    text, at = windows(sizes)
    # sections laid out with what comes before them, and room for the last window after them
    room = sizes + BEFORE + STRIDE
    base = np.cumsum(room) - room
    here = ragged(base + BEFORE, sizes)
    mine = ids[ragged(begin, sizes)]
    slotted = np.full(int(room.sum()) + 1, -1, np.int16)
    slotted[here] = c.of.astype(np.int16)[mine]
    entered = np.full(len(slotted) + 1, SLOTS, np.int16)
    entered[here + 1] = slotted[here]
    for i in np.flatnonzero(begin > starts):
        seen = ids[max(int(starts[i]), int(begin[i]) - BEFORE - 1) : begin[i]]
        entered[base[i] + BEFORE + 1 - len(seen) : base[i] + BEFORE + 1] = c.of[seen]
    total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=c.share[mine], minlength=len(sizes))
    first, ones = base[text] + at, np.ones((CONTEXT, 1), np.float32)
    above, last, space = upper(p), p[nodes(LEVELS - 1)], Room()
    for i in range(0, len(text), batch):
        x = entered[first[i : i + batch, None] + np.arange(CONTEXT)]
        now = x[:, BEFORE:]
        q = q_slot.take(now, axis=0, mode="clip")
        q += q_place
        k = k_slot.take(x, axis=0, mode="clip")
        k += k_place
        v = v_slot.take(x, axis=0, mode="clip")
        v += v_place
        s = q @ k.transpose(0, 2, 1)
        s += MASK[BEFORE:]
        np.exp(np.minimum(s, LARGEST, out=s), out=s)
        s /= s @ ones
        h = p["embed"].take(now, axis=0, mode="clip")
        h += p["place"][BEFORE:]
        h += s @ v
        want = slotted[first[i : i + batch, None] + np.arange(BEFORE, CONTEXT)].ravel()
        on = np.flatnonzero(want >= 0)
        # by slot from here on, so that what goes down one branch is one product
        on = on[np.argsort(want[on], kind="stable")]
        want, h = want[on], biased(h.reshape(-1, WIDTH).take(on, axis=0))
        u = h @ p["up"]
        np.maximum(u, 0, out=u)
        h[:, :-1] += u @ p["down"]
        chance = sum(soft(e, branch)[2] for e, branch in zip(branches(above, last, h, ways(want), space), steps(want)))
        total += np.bincount(text[i + on // STRIDE], weights=chance, minlength=len(total)) / np.log(10)
    return total


def blocks(texts: pa.Array, salt: np.ndarray, share: int, number: int, size: int = BLOCK_BYTES) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One in ``share`` of each text's blocks of about ``size`` bytes, one at least, as texts of whole words, and
    whether each is its text's first and last. ``salt`` (per text) and ``number`` say which."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    n = np.maximum(-(-np.diff(offsets) // size), 1)
    step = np.minimum(n, share)
    first = (salt + number) % step
    each = -(-(n - first) // step)
    of = np.repeat(np.arange(len(n)), each)
    which = first[of] + ragged(np.zeros(len(n), np.int64), each) * step[of]
    # from behind the last white space before the block to the first one after it
    space = np.flatnonzero(SPACES[raw[: offsets[-1]]])
    nominal = offsets[of] + which * size
    before = np.concatenate([[0], space + 1])[np.searchsorted(space, nominal, side="left")]
    begin = np.where(which == 0, offsets[of], np.maximum(offsets[of], before))
    after = np.concatenate([space, [len(raw)]])[np.searchsorted(space, nominal + size, side="left")]
    end = np.where(which == n[of] - 1, offsets[of + 1], np.minimum(offsets[of + 1], after))
    sizes = end - begin
    chosen = raw[ragged(begin, sizes)]
    out = pa.LargeStringArray.from_buffers(len(of), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(chosen))
    return out, begin == offsets[of], end == offsets[of + 1]


def training_windows(c: Slots, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and wanted slots of windows that hold every id once, of texts that end with their end id. Windows
    of a text begin a random number of places before it. Of blocks from within a text, the end (not ``last``),
    what doesn't fill a window, and a few first ids (not ``first``), whose past is unknown, aren't used."""
    starts, ends = offsets[:-1], offsets[1:] - (0 if last is None else (~last).astype(np.int64))
    phase = np.random.default_rng(seed).integers(0, CONTEXT, len(starts))
    from_ = starts + (-phase if first is None else np.where(first, -phase, 1 + phase % 8))
    size = np.maximum(ends - from_, 0)
    each = -(-size // CONTEXT)
    if last is not None:  # the rest of a block isn't worth a window
        each = np.where(last | (each < 2), each, size // CONTEXT)
    text = np.repeat(np.arange(len(each)), each)
    at = from_[text] + ragged(np.zeros(len(each), np.int64), each) * CONTEXT + BEFORE
    return inputs_at(c.of[ids], starts[text], ends[text], at)


def dealt_windows(c: Slots, offsets: np.ndarray, ids: np.ndarray, salt: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and wanted slots of each text's windows of round ``number``: the rounds together hold every id once.
    Where a text's windows begin, and which round has the first, is told by its ``salt``."""
    starts, ends, phase = offsets[:-1], offsets[1:], salt % CONTEXT
    each = -(-(ends - starts + phase) // CONTEXT)
    first = (number - salt // CONTEXT) % ROUNDS
    mine = np.maximum(-(-(each - first) // ROUNDS), 0)
    text = np.repeat(np.arange(len(each)), mine)
    which = first[text] + ragged(np.zeros(len(each), np.int64), mine) * ROUNDS
    return inputs_at(c.of[ids], starts[text], ends[text], (starts - phase)[text] + which * CONTEXT + BEFORE)


def train(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, adam: Adam, steps: int | None = None, seed: int = 1) -> float:
    """One pass over the windows, or ``steps`` batches of them; the mean loss of the last few."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x)) if steps is None else rng.integers(0, len(x), steps * BATCH)
    losses, room = [], Room()
    for i in range(0, len(order), BATCH):
        rows = order[i : i + BATCH]
        loss, d = gradients(p, x[rows], y[rows], room)
        adam.update(p, d)
        losses.append(loss)
    return float(np.mean(losses[-20:])) if losses else float("nan")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in NAMES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, shape in shapes().items():
        size = int(np.prod(shape))
        out[n] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents; a text's end is the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                w = words(texts, fold_table())
                n = np.bincount(w.codes, minlength=len(w.distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*w.distinct, ""], pa.string()), pa.array(np.append(n, rows.num_rows))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(counts: DataFrame, raw) -> np.ndarray:
    """Occurrences of each subword id in the training documents, from those of the words; at most
    VOCABULARY numbers per partition and on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for rows, texts in slices(batch, "word"):
                ends = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0  # the word '' is a text's end
                offsets, ids = loaded(raw.value).batch(texts)
                n = rows.column("n").to_numpy()
                np.add.at(total, ids, np.repeat(n, np.diff(offsets)))
                total[END_ID] += n[ends].sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(VOCABULARY, np.int64)
    total[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return total


def most_frequent(counts: DataFrame, limit: int = HEAD) -> dict[str, int]:
    """All words above the smallest count that leaves at most ``limit`` of them."""
    top = 1_000_000
    histogram = sorted(counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["n"])
    least, held = None, 0
    for r in histogram:
        held += r["words"]
        if held > limit:
            break
        least = r["n"]
    return {} if least is None else {r["word"]: r["n"] for r in counts.filter(F.col("n") >= least).collect()}


def fit(training: DataFrame, counts: DataFrame, raw, encoded: DataFrame) -> tuple[Slots, dict[str, np.ndarray]]:
    """Slots from the words of all training documents, weights from a first sample and rounds over all partitions of
    the same documents, ``encoded`` to ids."""
    spark = training.sparkSession
    c = slots(id_counts(counts, raw))
    ends = counts.filter("word = ''").first()
    started = first_weights(training, ends["n"] if ends else 0, c, raw)
    if started is None:
        return c, fresh()
    p, size = started
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((c, p, size))
        p = round_(encoded, raw, sent, number) or p
    return c, p


def salted(docs: DataFrame, column: str = "text") -> DataFrame:
    """(text, salt) of all texts; null counts as empty."""
    return docs.select(F.coalesce(column, F.lit("")).alias(column) if column == "text" else column, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("salt"))


def as_bytes(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Each text's ids as a column of bytes, two to an id."""
    small = ids.astype(np.uint16)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((2 * offsets).astype(np.int64)), pa.py_buffer(small)]).cast(pa.binary())


def ids_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of the batch, offsets, ids) with about SECTION ids each; a longer text has a slice of its own."""
    if not batch.num_rows:
        return
    column = batch.column("ids").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
    ids, at = np.frombuffer(column.buffers()[2], np.uint16), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SECTION, side="right")) - 1)
        yield batch.slice(at, to - at), ends[at : to + 1] - ends[at], ids[ends[at] : ends[to]]
        at = to


def encoded(docs: DataFrame, raw) -> DataFrame:
    """(doc_id, ids) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), as_bytes(*loaded(raw.value).batch(texts, END_ID))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def block_windows(c: Slots, raw, rows: pa.RecordBatch, texts: pa.Array, share: int, number: int, size: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    chosen, first, last = blocks(texts, rows.column("salt").to_numpy(), share, number, size)
    return training_windows(c, *loaded(raw.value).batch(chosen, END_ID), first, last, number + len(chosen))


def first_weights(training: DataFrame, texts: int, c: Slots, raw) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None:
    """Weights, and how large their gradients are, from about SAMPLE of the texts, up to SAMPLE_BLOCKS blocks of
    each, in one task of bounded work."""
    sent = training.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for rows, some in slices(batch, "text"):
                for i in range(rows.num_rows):
                    share = max(1, -(-pc.binary_length(some[i]).as_py() // (SAMPLE_BYTES * SAMPLE_BLOCKS)))
                    found.append(block_windows(sent.value, raw, rows.slice(i, 1), some.slice(i, 1), share, 0, SAMPLE_BYTES))
        if found:
            x, y = (np.concatenate(z) for z in zip(*found))
            p, adam = fresh(), Adam(RATE)
            for part, slower in enumerate((1, 2, 5)):
                adam.rate = RATE / slower
                train(p, x, y, adam, FIRST_STEPS // 3, seed=part)
            yield pa.RecordBatch.from_arrays([pa.array([packed(p).tobytes()]), pa.array([packed(adam.second).tobytes()])], ["w", "size"])

    # one partition reads no more than about SAMPLE texts; a small corpus is taken whole
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    few = training.filter(F.length("text") > 0).withColumn("h", h).filter(F.col("h") < int(min(1.0, SAMPLE / max(texts, 1)) * (1 << 40)))
    some = few.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("salt"), "h").repartition(1).sortWithinPartitions("h", "salt").drop("h")
    rows = some.mapInArrow(run, "w binary, size binary").collect()
    return tuple(unpacked(np.frombuffer(x, np.float32)) for x in rows[0]) if rows else None


def round_(training: DataFrame, raw, sent, number: int) -> dict[str, np.ndarray] | None:
    """One round over texts or their ids: every partition trains from the same weights on its documents' windows of
    the round; the mean of the results, by windows. Weights travel in chunks and are summed as they come, so a task holds a few chunks
    and the driver one model's numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, start, size = sent.value
        p, seen, held = {n: a.copy() for n, a in start.items()}, 0, []
        # steps are as long as at the end of the first sample, however few a partition takes
        adam = Adam(RATE / 5 / 2**number, {n: np.zeros_like(a) for n, a in p.items()}, {n: a.copy() for n, a in size.items()}, WARM)

        def learn():
            nonlocal seen
            x, y = (np.concatenate(z) for z in zip(*held))
            held.clear()
            train(p, x, y, adam, seed=number)
            seen += len(x)

        for batch in batches:
            for rows, offsets, ids in ids_of(batch):
                held.append(dealt_windows(c, offsets, ids, rows.column("salt").to_numpy(), number))
                if sum(len(x) for x, _ in held) >= MIXED:
                    learn()
        if held:
            learn()
        if seen:
            flat = packed(p) * np.float32(seen)
            parts = [flat[a : a + CHUNK].tobytes() for a in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary()), pa.array(np.full(len(parts), seen, np.int64))], ["chunk", "w", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for chunk, w, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(w, np.float32).astype(np.float64)
                count[chunk] = count.get(chunk, 0) + n
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary()), pa.array([count[k] for k in keys], pa.int64())], ["chunk", "w", "n"])

    schema = "chunk int, w binary, n long"
    ids = training if "ids" in training.columns else encoded(training, raw)
    rows = salted(ids, "ids").mapInArrow(run, schema).repartition(16, "chunk").mapInArrow(add, schema).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["chunk"])
    return unpacked(np.concatenate([np.frombuffer(r["w"], np.float64) / r["n"] for r in rows]))


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    raw = spark.sparkContext.broadcast(open(tokenizer_path or default_path(), encoding="utf-8").read())
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(key)).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = saved(word_counts(training))
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    ends = counts.filter("word = ''").first()
    known = most_frequent(counts) | {"": ends["n"] if ends else 0}  # the end is in no text's rest
    base = lambda count: np.log10((count + 1.0) / (n + v + 1.0))
    common = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        end = known.get("", 0)
        for batch in batches:
            for rows, texts in slices(batch, "text", SCORED_BYTES):
                w = words(texts, fold_table())
                count = np.fromiter((known.get(x, -1) for x in w.distinct), np.int64, len(w.distinct))
                of = np.repeat(np.arange(rows.num_rows), np.diff(w.offsets))
                each = count[w.codes] if len(w.codes) else np.zeros(0, np.int64)
                on = each >= 0
                part = np.bincount(of, weights=np.where(on, base(np.maximum(each, 0)), 0), minlength=rows.num_rows) + base(end)
                n_known = np.bincount(of, weights=on, minlength=rows.num_rows).astype(np.int64) + (end > 0)
                # other words, once per text with their count
                pairs, times = np.unique((of[~on] << 32) + w.codes[~on], return_counts=True)
                bounds = np.searchsorted(pairs >> 32, np.arange(rows.num_rows + 1)).astype(np.int32)
                word = pa.array(w.distinct, pa.string()).take(pa.array(pairs & 0xFFFFFFFF))
                rest = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([word, pa.array(times.astype(np.int32))], ["word", "times"]))
                ids = as_bytes(*loaded(raw.value).encoded(w, END_ID))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(w.offsets) + 1), pa.array(n_known), pa.array(part), ids, rest], ["doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "rest"])

    rows = saved(docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, ids binary, rest array<struct<word:string,times:int>>").withColumn("row", F.monotonically_increasing_id()))
    sent = spark.sparkContext.broadcast(fit(training, counts, raw, rows.filter(~F.col("held_out"))))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, p = sent.value
        for batch in batches:
            for some, offsets, ids in ids_of(batch):
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(log_probabilities(p, c, offsets, ids))], [*some.schema.names[:-1], "score"])

    scored = saved(rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(scores, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"))
    rest = rows.select("row", F.inline("rest")).join(counts, "word", "left")
    logs = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1.0) / (n + v + 1.0))
    more = rest.groupBy("row").agg(F.sum(logs).alias("base_rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_rest"))
    out = scored.join(more, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), "score")
