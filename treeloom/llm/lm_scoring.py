"""LM scoring: a causal self-attention model on subword ids, and a word unigram base.

Model.  Words (lower case, each after a blank) become subword ids of a public byte-level
vocabulary.  The next id is predicted in three steps: p(id | context) = p(group | context) *
p(class | group, context) * p(id | class); frequent ids have a class of their own.  Groups and
classes come from one causal attention layer trained in numpy: a window holds ``CONTEXT`` ids before its first target and scores
``TARGETS`` ids; windows overlap so that each id is scored once, and a mask hides what lies
after a position or before the text.  Texts end with an end id, which is scored as well.

Training reads every id of every training document.  Counts of ids give the classes and
p(id | class).  Counts of (previous id, class) and, for the ``PAIRS`` most frequent pairs of
previous ids, of (pair, class) give tables of what follows; they are added to what the layer
says and stay as counted.  The layer's own weights are fitted on every window of every training
text: a text's windows are dealt by hash, ``ROW_WINDOWS`` of them at a time, over ``ROUNDS`` turns and
over shards of about ``SHARD_WINDOWS``; in a turn shards fit side by side by Adam, and then their
weights are averaged.  Shards and their order depend on the rows alone, not on how the table is
partitioned; ids are written once, by turn, and travel once, a turn at a time.

Base.  Token counts cover every training document.  Texts are read once, in pieces: a piece
keeps its texts as indices into its own sorted vocabulary of word hashes.  Vocabularies are cut
by hash range, counts of a range meet in one task (one entry for each piece and word, never
one for each occurrence), and go back to the pieces, where the sums are formed.  What is
gathered grows with the corpus, and no table of words reaches the driver or a broadcast.

Defined cases: null or empty text has the end token alone; repeated rows stay and count each;
a null id is never held out; without training documents every count is 0; an empty table
gives no rows; extra columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import functools
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.kernel import LOWER, SPACE, Words, byte_view, runs, slices
from treeloom.runtime import Scratch, few_rows, ship, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Every window of a text is fitted (one in STRIDE); windows of a shard, turns over which they are dealt, windows of a row.
STRIDE, SHARD_WINDOWS, ROUNDS, ROW_WINDOWS = 1, 1 << 20, 4, 512
BATCH, RATE = 2048, 0.02
#: Natural logarithms of the tables are kept in steps of this.
STEP = np.float32(1 / 16)
#: Weight of the shorter context in counts of what follows a longer one.
PRIOR = 4.0
#: Bound of the exponents of a softmax.
CLIP = np.float32(80)
CONTEXT, TARGETS = 8, 8
LENGTH = CONTEXT + TARGETS - 1
WIDTH, GROUPS, CLASSES, ROWS, PAIRS = 8, 32, 1024, 2048, 28_672
INNER = CLASSES // GROUPS
PIECE_BYTES = 1 << 20
#: Pieces, and rows of a turn's ids, that travel to a Python worker at once.
PIECES, RUNS = 4, 128
#: Bytes whose word tables, and subword ids whose windows, are held at once.
SLICE, IDS = 1 << 19, 100_000
#: Words whose ids a task keeps.
MET = 1 << 18
#: Distinct cells that a table of counts holds in a task.
TALLIED = 4 << 20
#: Vocabulary entries of one hash range.
RANGE_ENTRIES = 1_000_000
#: Windows scored at once; targets whose logits, and windows whose attention, fit a core's cache.
BLOCK, SOME, NEAR = 8192, 2048, 512


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r" [^ ]{0,63}|[^ ]{1,64}", mergeable_ranks=ranks, special_tokens={})


def word_begins(ranks: dict[bytes, int]) -> np.ndarray:
    out = np.zeros(max(ranks.values()) + 1, bool)
    out[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass
class Model:
    end: int
    class_of: np.ndarray
    inside: np.ndarray
    row_of: np.ndarray
    pairs: np.ndarray
    p: dict[str, np.ndarray]

    @functools.cached_property
    def rows_of_pairs(self) -> np.ndarray:
        return pair_rows(self.pairs)

    @functools.cached_property
    def made(self) -> tuple:
        return layer_tables(self.p)

    @functools.cached_property
    def tables(self) -> Tables:
        return Tables(self.p)

    def log10(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 probability of each id; ``begin`` gives for each id where its text starts."""
        ids = ids.astype(np.int64)
        out = self.inside.take(ids)
        cls, rows = self.class_of.take(ids), self.row_of.take(ids)
        n = len(ids)
        edge = int(self.row_of[self.end])
        before = context(self.rows_of_pairs, *preceding(rows, begin, edge))
        follow = self.tables
        # windows tile each text: targets begin at multiples of TARGETS from the text's start
        last = np.append(begin[1:] != begin[:-1], True) if n else np.zeros(0, bool)
        stop = np.flatnonzero(last) + 1
        start = begin.take(stop - 1)
        number = -(-(stop - start) // TARGETS)
        text = np.repeat(np.arange(len(stop)), number)
        first = start[text] + TARGETS * spans(np.zeros(len(number), np.int64), number)
        for i in range(0, len(first), BLOCK):
            at, of = first[i : i + BLOCK], text[i : i + BLOCK]
            inputs = rows.take(at[:, None] + np.arange(-CONTEXT, LENGTH - CONTEXT), mode="clip")
            limit = stop.take(of)
            edges = np.flatnonzero((at - start.take(of) < CONTEXT) | (at + LENGTH - CONTEXT > limit))
            place, bound = at[edges][:, None] + np.arange(-CONTEXT, LENGTH - CONTEXT), start[of[edges]][:, None]
            seen = (place >= bound) & (place < limit[edges][:, None])
            # position -1 of a text is the end id: the boundary before it
            inputs[edges] = np.where(seen, inputs[edges], edge)
            seen |= place == bound - 1
            h = np.empty((len(at), TARGETS, WIDTH), np.float32)
            for j, own in near(edges, len(at)):
                h[j : j + NEAR] = forward(self.made, inputs[j : j + NEAR], edges[own] - j, seen[own])[0]
            target = at[:, None] + np.arange(TARGETS)
            on = np.flatnonzero(target < limit[:, None])
            target = target.reshape(-1).take(on)
            want = cls.take(target)
            group = (want // INNER).astype(np.int16)
            order = np.argsort(group, kind="stable")  # by group, so that those of a group are one slice
            target, want, group = target.take(order), want.take(order), group.take(order)
            h, prev, inner = h.reshape(-1, WIDTH).take(on.take(order), 0), before.take(target), want % INNER
            follow.reach(self.made, h)
            cells, bound = follow.cells(prev, group), bounds(group)
            value = np.empty(len(h))
            for j in range(0, len(h), SOME):
                own = slice(j, j + SOME)
                one, of_one = _shares(follow.of_groups(h[own], prev[own]), group[own])
                two, of_two = _shares(follow.of_classes(h[own], cells[own], same_group(bound, j, j + SOME)), inner[own])
                value[own] = (one + two) * _PER_LN - np.log10(of_one * of_two)
            out[target] += value
        return out


def near(edges: np.ndarray, n: int):
    """Where each ``NEAR`` of n windows begin, and which of the sorted ``edges`` are among them."""
    begin = range(0, n, NEAR)
    cut = np.searchsorted(edges, [*begin, n]).tolist()
    return [(j, slice(x, y)) for j, x, y in zip(begin, cut, cut[1:])]


def preceding(rows: np.ndarray, begin: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the id before each id and of the one before that; outside a text lies the end id."""
    place = np.arange(len(rows)) - begin
    one, two = np.full(len(rows), edge, rows.dtype), np.full(len(rows), edge, rows.dtype)
    one[1:], two[2:] = rows[:-1], rows[:-2]
    one[place < 1], two[place < 2] = edge, edge
    return one, two


def context(rows_of_pairs: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Row of the tables of what follows: that of the pair of previous ids if it has one, else of the previous id."""
    at = rows_of_pairs.take(two.astype(np.int64) * ROWS + one)
    return np.where(at > 0, at, one)


def pair_rows(pairs: np.ndarray) -> np.ndarray:
    """Row of each possible pair of previous rows; 0 where it has none."""
    out = np.zeros(ROWS * ROWS, np.uint16)
    out[pairs] = ROWS + np.arange(len(pairs))
    return out


def bounds(group: np.ndarray) -> list[int]:
    """Where each group begins among sorted groups, and where the last one ends."""
    return np.searchsorted(group, np.arange(GROUPS + 1, dtype=group.dtype)).tolist()


def same_group(bound: list[int], begin: int, stop: int) -> list[tuple[int, slice]]:
    """The groups among places from ``begin`` on and before ``stop``, and the slice of each, counted from ``begin``."""
    return [(g, slice(max(x, begin) - begin, min(y, stop) - begin)) for g, (x, y) in enumerate(zip(bound, bound[1:])) if x < y and x < stop and y > begin]


def _at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of one column in each row."""
    return np.arange(0, z.size, z.shape[1]) + at


def _shares(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of logits, which are used up, one column and the sum of the exponentials."""
    own = z.reshape(-1).take(_at(z, at))
    np.exp(z, out=z)
    return own, (z @ _SUM_INNER[: z.shape[1]]).astype(np.float64)


class Tables:
    """Logits of the groups, or of the classes of one group. Exponents are clipped, not shifted, and that only where they can be so large."""

    def __init__(self, p: dict):
        self.p, self.less, self.classes = p, p["ng"] * STEP, p["nc"].reshape(-1, INNER)

    def reach(self, made: tuple, h: np.ndarray) -> None:
        """For rows of h from now on: the product of the longest row and the longest column bounds what the tables are taken from. Rows are measured only where the layer's weights do not bound them: h is a row and the product of a mean of rows."""
        limit = (CLIP - 256 * STEP) ** 2 / max((self.p["ug"] ** 2).sum(0).max(), (self.p["uc"] ** 2).sum(1).max(), np.float32(1e-30))
        e, adds = made[0], made[4]
        bound = (e**2).sum(1).max() * (1 + np.sqrt((adds**2).sum())) ** 2
        self.far = not bound < limit and len(h) > 0 and not np.einsum("ij,ij->i", h, h).max() < limit

    def cells(self, prev: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Rows of the table of classes."""
        return group.astype(np.int64) * len(self.less) + prev

    def of_groups(self, h: np.ndarray, prev: np.ndarray) -> np.ndarray:
        z = h @ self.p["ug"]
        z -= self.less.take(prev, 0)
        return np.clip(z, -CLIP, CLIP, out=z) if self.far else z

    def of_classes(self, h: np.ndarray, cells: np.ndarray, same: list[tuple[int, slice]]) -> np.ndarray:
        """``same`` has the slices of rows of a group: only the products are made group by group."""
        z = np.empty((len(h), INNER), np.float32)
        for g, own in same:
            np.matmul(h[own], self.p["uc"][g], out=z[own])
        less = self.classes.take(cells, 0).astype(np.float32)
        less *= STEP
        z -= less
        return np.clip(z, -CLIP, CLIP, out=z) if self.far else z


_PER_LN = 1 / np.log(10)
_SUM_KEYS, _SUM_WIDTH, _SUM_INNER = np.ones(LENGTH, np.float32), np.ones(WIDTH, np.float32), np.ones(max(GROUPS, INNER), np.float32)
#: 0 for what lies after a position.
_BEHIND = (np.arange(LENGTH)[None, :] <= np.arange(TARGETS)[:, None] + CONTEXT - 1).astype(np.float32)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The product along the last axis, as one product of matrices and not one for each window."""
    return (_flat(x) @ w).reshape(x.shape)


def layer_tables(p: dict) -> tuple:
    """Of each row what it is and what it asks of others; of each place how much it counts; the products of weights that ask and that add to a target; whether scores can be out of bounds."""
    e, asks, adds = p["e"], (p["q"] * np.float32(WIDTH**-0.5)) @ p["k"].T, p["v"] @ p["o"]
    ask = e @ asks
    far = not (ask**2).sum(1).max() * (e**2).sum(1).max() < 40.0**2
    return e, ask, np.exp(np.clip(p["r"], -20, 20)) * _BEHIND, asks, adds, far


def forward(made: tuple, inputs: np.ndarray, edges: np.ndarray, seen: np.ndarray) -> tuple:
    """What the layer holds at each target of each window; keys and values are the rows as they are, the weights stand before and after.

    ``seen`` masks the windows at ``edges``, the others are seen whole.
    """
    e, asking, places, _, adds, far = made
    x, ask = e.take(inputs, 0), asking.take(inputs[:, CONTEXT - 1 :], 0)
    across = np.ascontiguousarray(x.transpose(0, 2, 1))  # small products of arrays in order are the quicker ones
    a = ask @ across
    # exponents are clipped, not shifted: sums stay finite in single precision without a pass for the maximum
    if far:
        np.clip(a, -40, 40, out=a)
    np.exp(a, out=a)
    a *= places
    if len(edges):
        a[edges] *= seen[:, None, :]
    share = (1 / (_flat(a) @ _SUM_KEYS)).reshape(len(a), TARGETS, 1)
    mean = a @ x
    mean *= share
    h = _times(mean, adds)
    h += x[:, CONTEXT - 1 :]
    return h, (x, across, ask, a, share, mean)


#: Weights of the layer; the tables of what follows each id are counted, not fitted.
FITTED = ("e", "q", "k", "v", "o", "r", "ug", "uc")


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id, log10 p(id | class), row of each id and mass of each class, from the counts of all ids."""
    vocabulary = len(counts)
    order = np.argsort(-counts, kind="stable")
    class_of = np.empty(vocabulary, np.int64)
    own = CLASSES - INNER  # the last group holds all other ids, dealt by their mass
    class_of[order[:own]] = np.arange(min(own, vocabulary))
    if vocabulary > own:
        mass = np.cumsum(counts[order[own:]] + 0.01)
        class_of[order[own:]] = own + np.minimum(((mass - mass[0]) / mass[-1] * INNER).astype(np.int64), INNER - 1)
    smooth = counts + 0.05
    total = np.bincount(class_of, weights=smooth, minlength=CLASSES)
    inside = np.log10(smooth / total[class_of])
    row_of = np.empty(vocabulary, np.int64)
    row_of[order] = np.where(np.arange(vocabulary) < ROWS - 256, np.arange(vocabulary), ROWS - 256 + order % 256)
    return class_of, inside, row_of, total


def shares(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """p(class | context) of each row of counts, smoothed by the shorter context's."""
    return (counts + PRIOR * lower) / (counts.sum(1, keepdims=True) + PRIOR)


def follows(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-log p(group | context) and -log p(class | group, context) in steps of ``STEP``; the softmax makes up for what rounding takes."""
    whole = np.maximum(share, np.float32(1e-7)).reshape(len(share), GROUPS, INNER)
    group = whole.sum(2)
    steps = lambda x: np.minimum(np.rint(x / -STEP), 255).astype(np.uint8)
    return steps(np.log(group)), steps(np.log(whole) - np.log(group)[:, :, None])


def start(total: np.ndarray, singles: np.ndarray, seed: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights before training and p(class | previous id); ``singles`` counts (row of the previous id, class)."""
    r = np.random.default_rng(seed)
    f = lambda *shape, scale: (r.normal(0, scale, shape)).astype(np.float32)
    p = {"e": f(ROWS, WIDTH, scale=0.3), "q": f(WIDTH, WIDTH, scale=0.35), "k": f(WIDTH, WIDTH, scale=0.35), "v": f(WIDTH, WIDTH, scale=0.35), "o": f(WIDTH, WIDTH, scale=0.35), "r": np.zeros((TARGETS, LENGTH), np.float32), "ug": f(WIDTH, GROUPS, scale=0.05), "uc": f(GROUPS, WIDTH, INNER, scale=0.05)}
    mass = np.maximum(total, 1e-3)
    return p, shares(singles.reshape(ROWS, CLASSES).astype(np.float32), (mass / mass.sum()).astype(np.float32))


def join_tables(p: dict, low: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """The tables of previous ids and, after them, of pairs."""
    own = follows(low)
    p["ng"] = np.concatenate([own[0], *(g for g, _ in parts)])
    p["nc"] = np.empty((GROUPS, len(p["ng"]), INNER), np.uint8)
    at = 0
    for _, c in [own, *parts]:
        p["nc"][:, at : at + len(c)] = c.transpose(1, 0, 2)
        at += len(c)


def often(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``PAIRS`` most frequent keys, sorted; of equally frequent ones the least."""
    return np.sort(keys[np.lexsort((keys, -n))[:PAIRS]]).astype(np.int32)


def cut_windows(ids: np.ndarray, begins: np.ndarray, many: np.ndarray, phase: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """One in ``STRIDE`` windows of each text, from window ``phase`` on: (text, rows of ids, lead and number of targets)."""
    number = -(-many // TARGETS)
    taken = np.maximum(0, -(-(number - phase) // STRIDE))
    text = np.repeat(np.arange(len(many)), taken)
    nth = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
    at = begins[text] + (phase[text] + nth * STRIDE) * TARGETS
    place = at[:, None] + np.arange(-CONTEXT, TARGETS)
    lead = np.minimum(at - begins[text], CONTEXT)
    left = np.minimum(begins[text] + many[text] - at, TARGETS)
    inside = (place >= begins[text][:, None]) & (place < (at + left)[:, None])
    out = ids.take(place, mode="clip")
    out[~inside] = end
    return text, np.concatenate([out, lead[:, None], left[:, None]], 1)


def fit(p: dict, cut: np.ndarray, row_of: np.ndarray, class_of: np.ndarray, rows_of_pairs: np.ndarray, edge: int, rate: float, seed: int) -> None:
    """One pass of Adam over windows as ``cut_windows`` makes them, in place."""
    mixed = np.random.default_rng(seed).permutation(len(cut))
    m, v2 = {k: np.zeros_like(p[k]) for k in FITTED}, {k: np.zeros_like(p[k]) for k in FITTED}
    column = np.arange(LENGTH)
    follow = Tables(p)
    for step, i in enumerate(range(0, len(mixed), BATCH), 1):
        own = cut.take(mixed[i : i + BATCH], 0)
        ids, lead, left = own[:, :-2], own[:, -2].astype(np.int64), own[:, -1].astype(np.int64)
        rows = row_of.take(ids)
        inputs = np.ascontiguousarray(rows[:, :LENGTH])
        edges = np.flatnonzero((lead < CONTEXT - 1) | (left < LENGTH - CONTEXT))
        seen = (column >= CONTEXT - 1 - lead[edges][:, None]) & (column < CONTEXT + left[edges][:, None])
        on = np.flatnonzero(np.arange(TARGETS) < left[:, None])
        made = layer_tables(p)
        hidden, held = np.empty((len(own), TARGETS, WIDTH), np.float32), []
        for j, among in near(edges, len(own)):
            hidden[j : j + NEAR], x = forward(made, inputs[j : j + NEAR], edges[among] - j, seen[among])
            held.append(x)
        want = class_of.take(ids[:, CONTEXT:].reshape(-1).take(on))
        before = context(rows_of_pairs, rows[:, CONTEXT - 1 : -1], rows[:, CONTEXT - 2 : -2]).reshape(-1).take(on)
        group = (want // INNER).astype(np.int16)
        order = np.argsort(group, kind="stable")
        on = on.take(order)
        h, prev, inner, group = _flat(hidden).take(on, 0), before.take(order), (want % INNER).take(order), group.take(order)
        g = {"ug": np.zeros_like(p["ug"]), "uc": np.zeros_like(p["uc"])}
        follow.reach(made, h)
        cells, bound = follow.cells(prev, group), bounds(group)
        back = np.empty((len(group) + 1, WIDTH), np.float32)
        back[-1] = 0  # for places without a target
        for j in range(0, len(group), SOME):
            mine = slice(j, min(j + SOME, len(group)))
            same = same_group(bound, mine.start, mine.stop)
            back[mine] = _slope(follow.of_groups(h[mine], prev[mine]), group[mine], len(group), h[mine], [(p["ug"], g["ug"], slice(None))])
            back[mine] += _slope(follow.of_classes(h[mine], cells[mine], same), inner[mine], len(group), h[mine], [(p["uc"][c], g["uc"][c], rows_of) for c, rows_of in same])
        place = np.full(len(own) * TARGETS, len(group))
        place[on] = np.arange(len(group))
        dh = back.take(place, 0).reshape(hidden.shape)
        asks, adds = made[3:5]
        g["r"], g_asks, g_adds, dx = np.zeros_like(p["r"]), np.zeros_like(asks), np.zeros_like(adds), np.empty((len(own), LENGTH, WIDTH), np.float32)
        for j, (x, across, ask, a, share, mean) in zip(range(0, len(own), NEAR), held):
            own_dh = dh[j : j + NEAR]
            g_adds += _flat(mean).T @ _flat(own_dh)
            d = _times(own_dh, adds.T)
            d *= share
            ds = d @ across
            ds -= (_flat(d * mean) @ _SUM_WIDTH).reshape(share.shape)  # what the attention's shares sum to
            ds *= a
            g["r"] += ds.sum(0)
            dask = ds @ x
            g_asks += _flat(x[:, CONTEXT - 1 :]).T @ _flat(dask)
            back_x = np.matmul(np.concatenate([a, ds], 1).transpose(0, 2, 1), np.concatenate([d, ask], 1), out=dx[j : j + NEAR])  # as value and as key
            as_target = _times(dask, asks.T)
            as_target += own_dh
            back_x[:, CONTEXT - 1 :] += as_target
        scale = np.float32(WIDTH**-0.5)
        g["q"], g["k"], g["v"], g["o"] = g_asks @ p["k"] * scale, g_asks.T @ p["q"] * scale, g_adds @ p["o"].T, p["v"].T @ g_adds
        where = inputs.reshape(-1)
        g["e"] = np.stack([np.bincount(where, weights=x, minlength=ROWS) for x in _flat(dx).T.astype(np.float64, order="C")], 1).astype(np.float32)
        for key in FITTED:
            m[key] *= 0.9
            m[key] += 0.1 * g[key]
            v2[key] *= 0.99
            v2[key] += 0.01 * g[key] ** 2
            p[key] -= m[key] * (rate / (1 - 0.9**step)) / (np.sqrt(v2[key] * (1 / (1 - 0.99**step))) + 1e-8)


def train(texts: list[list[int]], end: int, vocabulary: int, epochs: int = 1, rate: float = RATE, seed: int = 3, stride: int | None = None) -> Model:
    """The same training of texts at hand, in one process and one part."""
    many = np.array([len(t) + 1 for t in texts], np.int64)
    ids = np.array([i for t in texts for i in [*t, end]], np.int64)
    class_of, inside, row_of, total = layout(np.bincount(ids, minlength=vocabulary))
    begins, edge = np.cumsum(many) - many, int(row_of[end])
    one, two = preceding(row_of[ids], np.repeat(begins, many), edge)
    p, low = start(total, np.bincount(one * CLASSES + class_of[ids], minlength=ROWS * CLASSES), seed)
    key, n = np.unique(two * ROWS + one, return_counts=True)
    pairs = often(key, n)
    table = pair_rows(pairs)
    row = context(table, one, two) - ROWS
    on = row >= 0
    counts = np.bincount(row[on] * CLASSES + class_of[ids[on]], minlength=len(pairs) * CLASSES).reshape(-1, CLASSES)
    join_tables(p, low, [follows(shares(counts.astype(np.float32), low[pairs % ROWS]))])
    cut = cut_windows(ids, begins, many, np.zeros(len(many), np.int64), end)[1] if len(ids) else np.zeros((0, LENGTH + 3), np.int64)
    for epoch in range(epochs):
        fit(p, cut, row_of, class_of, table, edge, rate, seed + epoch)
    return Model(end, class_of, inside, row_of, pairs, p)


def _slope(z: np.ndarray, at: np.ndarray, over: int, h: np.ndarray, parts: list[tuple]) -> np.ndarray:
    """Gradient of the cross entropy of rows of logits, a share of ``over`` each. ``parts`` has the weights of slices of rows: their gradients are added to what stands beside them, that of h is returned."""
    d = np.exp(z, out=z)
    total = d @ _SUM_INNER[: d.shape[1]]
    d.reshape(-1)[_at(d, at)] -= total
    # rows are divided by their sums where they are narrow
    share = (np.float32(1 / over) / total)[:, None]
    scaled, out = h * share, np.empty_like(h)
    for u, g, own in parts:
        g += scaled[own].T @ d[own]
        np.matmul(d[own], u.T, out=out[own])
    out *= share
    return out


def subwords(words: list[bytes], encode, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word, after a blank, as (flat, first); ``begins`` marks ids that hold a blank, which only a word's first id can."""
    flat = [np.zeros(0, np.int32)]
    for i in range(0, len(words), 8192):
        flat.append(np.array(encode((b" " + b" ".join(words[i : i + 8192])).decode("utf-8", "replace")), np.int32))
    ids = np.concatenate(flat)
    return ids, np.append(np.flatnonzero(begins[ids]), len(ids))


class Met:
    """Ids of the words that a task met, by hash, so that a word of several pieces is encoded once; past ``MET`` words it begins anew."""

    def __init__(self, encode, begins: np.ndarray):
        self.encode, self.begins = encode, begins
        self.forget()

    def forget(self) -> None:
        self.h, self.at, self.many, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids(self, vocabulary: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of a sorted vocabulary and how many each has; ``words`` gives the words at places of it."""
        if len(self.h) > MET:
            self.forget()
        place = np.searchsorted(self.h, vocabulary)
        known = place < len(self.h)
        known[known] = self.h[place[known]] == vocabulary[known]
        new = np.flatnonzero(~known)
        if len(new):
            flat, first = subwords(words(new), self.encode, self.begins)
            place = place[new]
            self.h, self.at, self.many = np.insert(self.h, place, vocabulary[new]), np.insert(self.at, place, first[:-1] + len(self.flat)), np.insert(self.many, place, np.diff(first))
            self.flat = np.concatenate([self.flat, flat])
        place = np.searchsorted(self.h, vocabulary)
        many = self.many[place].astype(np.int64)
        return self.flat.take(spans(self.at[place], many)), many


def piece_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte span and row of each word of a piece, and where each row's words begin; word tables are made a slice at a time."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    counts = []
    rows = at = 0
    for some in slices(part, "text", SLICE):
        buf, offsets = byte_view(some.column("text"))
        w = Words(buf, offsets, SPACE)
        for column, x in zip(columns, (w.h, w.start + at, w.end + at, w.row + rows)):
            column.append(x)
        counts.append(w.counts)
        rows += some.num_rows
        at += len(buf)
    h, start, end, row = (np.concatenate(c) for c in columns)
    return h, start, end, row, np.append(0, np.cumsum(np.concatenate(counts)))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, a place of each and the place of each in them. As np.unique, but without a stable sort."""
    order = np.argsort(h)
    ordered = h.take(order)
    new = np.ones(len(h), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


def piece_of(part: pa.RecordBatch, met: Met) -> tuple:
    """A piece's documents over its own vocabulary: word hashes, training counts, words, bounds of texts, ids of the words."""
    h, start, end, owner, bound = piece_words(part)
    vocabulary, sample, at = distinct(h)
    trains = part.column("trains").to_numpy(zero_copy_only=False).astype(bool)
    counts = np.bincount(at[trains[owner]], minlength=len(vocabulary)) if len(at) else np.zeros(0, np.int64)
    whole = LOWER[byte_view(part.column("text"))[0]].tobytes()
    flat, sizes = met.ids(vocabulary, lambda new: [whole[a:b] for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())])
    return vocabulary, counts.astype(np.uint32), at.astype(np.uint32), bound.astype(np.int64), flat, sizes.astype(np.uint32)


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


def id_blocks(at: np.ndarray, bound: np.ndarray, flat: np.ndarray, sizes: np.ndarray, end: int):
    """Ids of a piece's texts, each with its end id, a bounded number of ids or one text at a time: (first text, ids, begins, lengths)."""
    flat, sizes = np.append(flat, np.array([end], flat.dtype)), np.append(sizes.astype(np.int64), 1)  # the end is one more word
    at, bound = np.insert(at.astype(np.int32), bound[1:], len(sizes) - 1), bound + np.arange(len(bound))
    length = sizes.take(at)
    start = (np.cumsum(sizes) - sizes).take(at)
    ends = np.append(0, np.cumsum(length)).take(bound)
    row, rows = 0, len(bound) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + IDS)) - 1)
        own = slice(bound[row], bound[to])
        yield row, flat.take(spans(start[own], length[own])), ends[row:to] - ends[row], np.diff(ends[row : to + 1])
        row = to


def lean(make):
    """Makers of functions over batches that, when a task ends, give the memory they freed back to the system."""

    def made(*args):
        run = make(*args)

        def out(batches):
            try:
                yield from run(batches)
            finally:
                pa.default_memory_pool().release_unused()
                with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
                    ctypes.CDLL(None).malloc_trim(0)

        return out

    return made


@lean
def _pieces(sent):
    def run(batches):
        ranks = sent.value
        met = Met(encoder(ranks)._core_bpe.encode_ordinary, word_begins(ranks))
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                vocabulary, counts, tokens, first, flat, sizes = piece_of(part, met)
                cell = lambda x: pa.array([x.tobytes()], pa.binary())
                ids, held = part.column("doc_id"), part.column("held_out")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), cell(vocabulary), cell(counts), cell(_narrow(tokens, len(vocabulary))), cell(first), cell(flat.astype(_id_type(len(ranks)))), cell(sizes), pa.array([len(vocabulary)], pa.int64()), pa.array([int(np.sum(part.column("trains").to_numpy(zero_copy_only=False)))], pa.int64())],
                    names=["piece", "ids", "held", "vocabulary", "counts", "tokens", "first", "flat", "sizes", "entries", "trained"],
                )

    return run


def _narrow(tokens: np.ndarray, vocabulary: int) -> np.ndarray:
    return tokens.astype(np.uint16) if vocabulary <= 1 << 16 else tokens


def _tokens(cell, first: np.ndarray) -> np.ndarray:
    """Places in a piece's vocabulary, of two or four bytes by its size."""
    return np.frombuffer(cell, np.uint16 if len(cell) == 2 * first[-1] else np.uint32)


def _id_type(end: int):
    return np.uint16 if end < 1 << 16 else np.uint32


def _cells(batch: pa.RecordBatch, names: list[str], kinds: list):
    """Rows of a batch, binary columns as arrays that share its memory."""
    columns = [batch.column(n) for n in names]
    for row in range(batch.num_rows):
        yield [np.frombuffer(c[row].as_buffer(), k) if k is not None else c[row].as_py() for c, k in zip(columns, kinds)]


@lean
def _id_counts(end: int):
    """How often each id occurs in a task's training texts."""

    def run(batches):
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            for counts, flat, sizes, trained in _cells(batch, ["counts", "flat", "sizes", "trained"], [np.uint32, _id_type(end), np.uint32, None]):
                total += np.bincount(flat, weights=np.repeat(counts, sizes), minlength=end + 1).astype(np.int64)
                total[end] += trained
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["id", "n"])

    return run


PIECE_CELLS = ["held", "tokens", "first", "flat", "sizes"]


def _training_ids(batch: pa.RecordBatch, end: int):
    """Ids of a batch's training texts, block by block: (first text, ids, begins, lengths, whether a text trains)."""
    for held, tokens, first, flat, sizes in _cells(batch, PIECE_CELLS, [None, np.uint8, np.int64, _id_type(end), np.uint32]):
        trains = ~np.array(held, bool)
        for row, ids, begins, many in id_blocks(_tokens(tokens, first), first, flat, sizes, end):
            yield row, ids, begins, many, trains[row : row + len(many)]


@lean
def _runs_of_ids(end: int, shards: int, turn: int | None, rounds: int):
    """The ids of a turn, or of all turns with the turn of each row: ``ROW_WINDOWS`` windows of a text in a row, after the ids before them (none or ``CONTEXT``).

    Rows are dealt by a text's id, its number of ids, three of them and the row's number, so that only texts of the turn are spelled out.
    """
    size = ROW_WINDOWS * TARGETS

    def run(batches):
        for batch in batches:
            for docs, held, tokens, first, flat, sizes in _cells(batch, ["ids", *PIECE_CELLS], [None, None, np.uint8, np.int64, _id_type(end), np.uint32]):
                at = _tokens(tokens, first)
                many = np.diff(np.append(0, np.cumsum(sizes.take(at), dtype=np.int64)).take(first)) + 1
                dealt: dict[int, list[tuple[int, int, int]]] = {}
                for j, length, *some in zip(range(len(docs)), many.tolist(), *_marks(at, first, flat, sizes, end)):
                    if not held[j]:
                        for number in range(-(-length // size)):
                            x = zlib.crc32(f"{docs[j]} {number} {length} {some}".encode())
                            if turn is None or x % rounds == turn:
                                dealt.setdefault(j, []).append((number, x // rounds % shards, x % rounds))
                texts = list(dealt)
                if not texts:
                    continue
                words = np.diff(first)[texts]
                own = at.take(spans(first[:-1][texts], words))
                for row, ids, begins, length in id_blocks(own, np.append(0, np.cumsum(words)), flat, sizes, end):
                    out: list[list] = [[], [], [], [], []]
                    whole, wide = ids.tobytes(), ids.itemsize
                    for j, begin, stop in zip(texts[row : row + len(begins)], begins.tolist(), (begins + length).tolist()):
                        for number, shard, own_turn in dealt[j]:
                            place = begin + number * size
                            data = whole[max(begin, place - CONTEXT) * wide : min(place + size, stop) * wide]
                            for column, value in zip(out, (shard, docs[j], number, data, own_turn)):
                                column.append(value)
                    columns = [pa.array(x, kind) for x, kind in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))]
                    n = 4 if turn is not None else 5
                    yield pa.RecordBatch.from_arrays(columns[:n], names=["shard", "doc_id", "number", "data", "turn"][:n])

    return run


def _marks(at: np.ndarray, first: np.ndarray, flat: np.ndarray, sizes: np.ndarray, end: int) -> list[list[int]]:
    """The first ids of each text's first, middle and last word; the end's of a text without any."""
    begin, flat = np.append(np.cumsum(sizes, dtype=np.int64) - sizes, len(flat)), np.append(flat, np.array([end], flat.dtype))
    at, bare = np.append(at.astype(np.int64), len(sizes)), np.diff(first) == 0
    return [flat[begin[at[np.where(bare, len(at) - 1, place)]]].tolist() for place in (first[:-1], (first[:-1] + first[1:]) // 2, first[1:] - 1)]


def row_windows(data: list[bytes], numbers: list[int], end: int) -> np.ndarray:
    """Every window of rows of ids; those of a text's later rows begin after the ``CONTEXT`` ids that belong to the row before."""
    kind = _id_type(end)
    out = [np.zeros((0, LENGTH + 3), kind)]
    for i in range(0, len(data), 64):
        ids = np.frombuffer(b"".join(data[i : i + 64]), kind)
        many = np.array([len(x) // ids.itemsize for x in data[i : i + 64]])
        phase = np.minimum(numbers[i : i + 64], 1) * (CONTEXT // TARGETS)
        out.append(cut_windows(ids, np.cumsum(many) - many, many, phase, end)[1].astype(kind))
    return np.concatenate(out)


#: Blocks in which tables of counts of previous ids, of pairs of them and of what follows pairs are summed.
SINGLE_BLOCKS, KEY_BLOCKS, PAIR_BLOCKS = 16, 64, 56
COUNTS = "block int, at binary, n binary"


def _block_rows(at: np.ndarray, n: np.ndarray, cells: int, blocks: int, base: int = 0):
    """Sorted cells with their counts as rows of blocks; blocks without any are left out."""
    bound = np.searchsorted(at, np.arange(blocks + 1) * (cells // blocks))
    for block in np.flatnonzero(np.diff(bound)):
        own = slice(bound[block], bound[block + 1])
        yield pa.RecordBatch.from_arrays([pa.array([base + int(block)], pa.int32()), pa.array([(at[own] - block * (cells // blocks)).astype(np.uint32).tobytes()], pa.binary()), pa.array([n[own].astype(np.int64).tobytes()], pa.binary())], names=["block", "at", "n"])


class Tally:
    """Counts of cells; past ``TALLIED`` distinct ones it gives them out and begins anew, so memory stays bounded."""

    def __init__(self, cells: int, blocks: int, base: int = 0):
        self.shape, self.held, self.many = (cells, blocks, base), [], 0
        self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, cells: np.ndarray):
        self.held.append(cells.astype(np.int32))
        self.many += len(cells)
        if self.many >= TALLIED // 4:
            self._merge()
            if len(self.at) > TALLIED:
                yield from self.rows()

    def rows(self):
        self._merge()
        yield from _block_rows(self.at, self.n, *self.shape)
        self.at, self.n = self.at[:0], self.n[:0]

    def _merge(self) -> None:
        if not self.many:
            return
        new = np.concatenate(self.held)
        self.held, self.many = [], 0
        new.sort()
        first = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
        n = np.diff(np.append(first, len(new))).astype(np.int32)
        new = new[first]
        place = np.searchsorted(self.at, new)
        known = place < len(self.at)
        known[known] = self.at[place[known]] == new[known]
        self.n[place[known]] += n[known]
        place, new, n = place[~known], new[~known], n[~known]
        if len(new):
            self.at, self.n = np.insert(self.at, place, new), np.insert(self.n, place, n)


@lean
def _singles(sent, end: int):
    """Counts over a task's training ids of (row of the previous id, class), and of pairs of previous rows."""

    def run(batches):
        class_of, row_of = (x.astype(np.int32) for x in sent.value)
        edge = int(row_of[end])
        singles, keys = Tally(ROWS * CLASSES, SINGLE_BLOCKS), Tally(ROWS * ROWS, KEY_BLOCKS, SINGLE_BLOCKS)
        for batch in batches:
            for _, ids, begins, many, trains in _training_ids(batch, end):
                on = np.repeat(trains, many)
                one, two = preceding(row_of.take(ids), np.repeat(begins, many), edge)
                yield from singles.add((one * CLASSES + class_of.take(ids))[on])
                yield from keys.add((two * ROWS + one)[on])
        yield from singles.rows()
        yield from keys.rows()

    return run


@lean
def _add_blocks(cells: dict[int, int]):
    """Sums of blocks of ``cells`` counts each; of pairs of previous rows the most frequent ones stay."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in _cells(batch, ["block", "at", "n"], [None, np.uint32, np.int64]):
                kind = 0 if block < SINGLE_BLOCKS else 1
                totals.setdefault(block, np.zeros(cells[kind], np.int64))[at] += n
        for block, total in totals.items():
            on = np.flatnonzero(total)
            if block >= SINGLE_BLOCKS:
                on = often(on, total[on]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([on.astype(np.uint32).tobytes()], pa.binary()), pa.array([total[on].tobytes()], pa.binary())], names=["block", "at", "n"])

    return run


@lean
def _pair_counts(sent, end: int):
    """Counts over a task's training ids of (pair, class)."""

    def run(batches):
        class_of, row_of, pairs, _ = sent.value
        class_of, row_of = class_of.astype(np.int32), row_of.astype(np.int32)
        edge, table = int(row_of[end]), pair_rows(pairs)
        total = Tally(PAIRS * CLASSES, PAIR_BLOCKS)
        for batch in batches:
            for _, ids, begins, many, trains in _training_ids(batch, end):
                row = context(table, *preceding(row_of.take(ids), np.repeat(begins, many), edge)) - ROWS
                on = np.flatnonzero(np.repeat(trains, many) & (row >= 0))
                yield from total.add(row.take(on) * CLASSES + class_of.take(ids.take(on)))
        yield from total.rows()

    return run


@lean
def _pair_tables(sent):
    """What follows the pairs of a block, from the sums of its counts."""

    def run(batches):
        _, _, pairs, low = sent.value
        own = PAIRS // PAIR_BLOCKS
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in _cells(batch, ["block", "at", "n"], [None, np.uint32, np.int64]):
                totals.setdefault(block, np.zeros(own * CLASSES, np.float32))[at] += n
        for block, total in totals.items():
            keys = pairs[block * own : (block + 1) * own]
            group, inner = follows(shares(total.reshape(-1, CLASSES)[: len(keys)], low[keys % ROWS].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group.tobytes()], pa.binary()), pa.array([inner.tobytes()], pa.binary())], names=["block", "at", "n"])

    return run


def _pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in FITTED]).astype(np.float64)


def _unpack(p: dict, flat: np.ndarray) -> None:
    at = 0
    for k in FITTED:
        p[k] = flat[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
        at += p[k].size


@lean
def _fit_shards(sent, weights, turn: int, rate: float):
    """Weights of each shard after all its windows of one turn, times the windows."""

    def run(batches):
        model = sent.value
        edge = int(model.row_of[model.end])
        for group in runs(batches, ["shard"]):
            shard = group.column("shard")[0].as_py()
            cut = row_windows(group.column("data").to_pylist(), group.column("number").to_pylist(), model.end)
            p = dict(model.p)
            _unpack(p, weights.value)
            fit(p, cut, model.row_of, model.class_of, model.rows_of_pairs, edge, rate, 3 + shard + 7919 * turn)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(cut)], pa.int64()), pa.array([(_pack(p) * len(cut)).tobytes()], pa.binary())], names=["shard", "n", "w"])

    return run


def _add_weights(batches):
    n, w = 0, 0.0
    for batch in batches:
        for _, many, own in _cells(batch, ["shard", "n", "w"], [None, None, np.float64]):
            n, w = n + many, w + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["shard", "n", "w"])


@lean
def _scores(sent, weights):
    def run(batches):
        model = fitted(sent, weights)
        for batch in batches:
            cells = []
            for tokens, first, flat, sizes in _cells(batch, ["tokens", "first", "flat", "sizes"], [np.uint8, np.int64, _id_type(model.end), np.uint32]):
                parts = [np.add.reduceat(model.log10(ids, np.repeat(begins, many)), begins) for _, ids, begins, many in id_blocks(_tokens(tokens, first), first, flat, sizes, model.end)]
                cells.append(np.concatenate(parts).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("piece", "ids", "held", "tokens", "first")), pa.array(cells, pa.binary())], names=["piece", "ids", "held", "tokens", "first", "score"])

    return run


@lean
def _ranges(n: int):
    """A piece's vocabulary cut into hash ranges."""

    def run(batches):
        edges = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
        for batch in batches:
            for piece, v, c in zip(batch.column("piece").to_pylist(), batch.column("vocabulary").to_pylist(), batch.column("counts").to_pylist()):
                h, counts = np.frombuffer(v, np.uint64), np.frombuffer(c, np.uint32)
                cut = np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
                on = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array([piece] * len(on)), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in on], pa.binary()), pa.array([counts[cut[i] : cut[i + 1]].tobytes() for i in on], pa.binary())], names=["range", "piece", "h", "c"])

    return run


@lean
def _totals():
    """Counts of a range summed over pieces and handed back to each; the row without a piece holds the range's distinct and total."""

    def run(batches):
        for group in runs(batches, ["range"]):
            blobs = group.column("h").to_pylist()
            h = np.frombuffer(b"".join(blobs), np.uint64)
            c = np.frombuffer(b"".join(group.column("c").to_pylist()), np.uint32).astype(np.int64)
            words, _, at = distinct(h)
            total = np.bincount(at, weights=c, minlength=len(words)).astype(np.int64)
            back = total[at]
            size = np.cumsum([0] + [len(b) // 8 for b in blobs])
            pieces = group.column("piece").to_pylist()
            n = group.column("range")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([n] * (len(pieces) + 1), pa.int32()), pa.array([*pieces, None], pa.int64()), pa.array([*(back[size[i] : size[i + 1]].tobytes() for i in range(len(pieces))), None], pa.binary()), pa.array([0] * len(pieces) + [int((total > 0).sum())], pa.int64()), pa.array([0] * len(pieces) + [int(total.sum())], pa.int64())], names=["range", "piece", "total", "distinct", "sum"])

    return run


@lean
def _sums(words: int, distinct: int, trained: int):
    n = words + trained
    v = distinct + (trained > 0)
    floor = np.log10(n + 0.1 * (v + 1))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = sorted(row["totals"] or [], key=lambda x: x["range"])
                total = np.frombuffer(b"".join(x["total"] for x in got), np.int64)
                value = np.log10(total + 0.1) - floor
                first = np.frombuffer(row["first"], np.int64)
                tokens = _tokens(row["tokens"], first)
                sums, known = np.append(0.0, np.cumsum(value[tokens])), np.append(0, np.cumsum(total[tokens] > 0))
                # each text is summed on its own, so a long piece loses no digits
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                base = np.bincount(owner, weights=value[tokens], minlength=len(first) - 1) if len(tokens) else np.zeros(len(first) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.diff(first) + 1), pa.array(known[first[1:]] - known[first[:-1]] + (trained > 0)), pa.array(np.full(len(first) - 1, n)), pa.array(base + np.log10(trained + 0.1) - floor), pa.array(np.frombuffer(row["score"]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def learn(pieces: DataFrame, scratch: Scratch, end: int, shard_windows: int = SHARD_WINDOWS) -> tuple:
    """The attention model from every training text of the pieces: its tables and its fitted weights, as broadcasts."""
    sc = pieces.sparkSession.sparkContext
    got = pieces.select("counts", "flat", "sizes", "trained").mapInArrow(_id_counts(end), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row for each id of a fixed vocabulary
    counts = np.zeros(end + 1, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    class_of, inside, row_of, total = layout(counts)
    shards = max(1, -(-int(counts.sum()) // (TARGETS * shard_windows)))

    # the tables have a fixed number of cells, and a task sums what it read before it sends any
    few = pieces.select(*PIECE_CELLS).coalesce(4 * sc.defaultParallelism)
    sent = sc.broadcast((class_of, row_of))
    summed = few.mapInArrow(_singles(sent, end), COUNTS).repartition(SINGLE_BLOCKS + KEY_BLOCKS, "block")
    singles, keys, often_n = np.zeros((SINGLE_BLOCKS, ROWS * CLASSES // SINGLE_BLOCKS), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    found = summed.mapInArrow(_add_blocks({0: singles.shape[1], 1: ROWS * ROWS // KEY_BLOCKS}), COUNTS).toArrow()
    for block, at, n in zip(*(found.column(c).to_pylist() for c in ("block", "at", "n"))):
        at, n = np.frombuffer(at, np.uint32).astype(np.int64), np.frombuffer(n, np.int64)
        if block < SINGLE_BLOCKS:
            singles[block, at] = n
        else:
            keys.append(at + (block - SINGLE_BLOCKS) * (ROWS * ROWS // KEY_BLOCKS))
            often_n.append(n)
    pairs = often(np.concatenate(keys), np.concatenate(often_n))
    p, low = start(total, singles.ravel(), 3)
    sent.destroy()
    sent = sc.broadcast((class_of, row_of, pairs, low.astype(np.float16)))
    summed = few.mapInArrow(_pair_counts(sent, end), COUNTS).repartition(PAIR_BLOCKS, "block")
    tables = summed.mapInArrow(_pair_tables(sent), COUNTS).toArrow()
    parts = sorted(zip(*(tables.column(c).to_pylist() for c in ("block", "at", "n"))))
    join_tables(p, low, [(np.frombuffer(g, np.uint8).reshape(-1, GROUPS), np.frombuffer(c, np.uint8).reshape(-1, GROUPS, INNER)) for _, g, c in parts])
    sent.destroy()
    del tables, parts, low
    flat = _pack(p)
    model = Model(end, class_of, inside, row_of, pairs, p)
    sent = sc.broadcast(model)
    del model, p
    # the pieces are read once for all turns; a turn's rows are deleted after it
    turns = Scratch(few_rows(pieces.sparkSession, RUNS))
    dealt = turns.cut(pieces.select("ids", *PIECE_CELLS).mapInArrow(_runs_of_ids(end, shards, None, ROUNDS), "shard int, doc_id long, number long, data binary, turn int"), "turn")
    for turn in range(ROUNDS):
        weights = sc.broadcast(flat)
        own = dealt.where(F.col("turn") == turn).drop("turn").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "number", "data")  # a shard is one task's, in order
        fitted = own.mapInArrow(_fit_shards(sent, weights, turn, RATE / (1 + turn)), "shard int, n long, w binary")
        sums = fitted.repartition(min(32, shards), "shard").sortWithinPartitions("shard").mapInArrow(_add_weights, "shard int, n long, w binary").toArrow()  # at most 32 sums of weights
        n = sum(sums.column("n").to_pylist())
        if n:
            flat = sum(np.frombuffer(w, np.float64) for w in sums.column("w").to_pylist()) / n
        weights.destroy()
        del own, fitted
        turns.drop_part(dealt, f"turn={turn}")
        scratch.release()
    turns.drop(dealt)
    return sent, sc.broadcast(flat)


def fitted(sent, weights) -> Model:
    """The model of a pair of broadcasts."""
    model = sent.value
    out = Model(model.end, model.class_of, model.inside, model.row_of, model.pairs, dict(model.p))
    _unpack(out.p, weights.value)
    return out


def score(documents: DataFrame, vocabulary: str = VOCABULARY, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    held = F.coalesce(F.crc32(F.col(doc).cast("string")) % 10 == 0, F.lit(False))
    rows = documents.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held.alias("held_out"), (~held).alias("trains"))
    ranks = read_ranks(vocabulary)
    schema = "piece long, ids array<long>, held array<boolean>, vocabulary binary, counts binary, tokens binary, first binary, flat binary, sizes binary, entries long, trained long"
    pieces = Scratch(few_rows(spark, PIECES)).cut(rows.mapInArrow(_pieces(spark.sparkContext.broadcast(ranks)), schema))
    sent, weights = learn(pieces, scratch, len(ranks))  # tables and weights of a fixed size
    size = pieces.agg(F.sum("entries"), F.sum("trained")).first()
    ranges = max(1, -(-(size[0] or 0) // RANGE_ENTRIES))
    cut = pieces.select("piece", "vocabulary", "counts").mapInArrow(_ranges(ranges), "range int, piece long, h binary, c binary")
    totals = scratch.cut(cut.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "piece").mapInArrow(_totals(), "range int, piece long, total binary, distinct long, sum long"))
    scratch.release()
    whole = totals.where("piece is null").agg(F.sum("sum"), F.sum("distinct")).first()
    back = totals.where("piece is not null").groupBy("piece").agg(F.collect_list(F.struct("range", "total")).alias("totals"))  # a piece's own vocabulary: bounded by its bytes
    scored = pieces.select("piece", "ids", "held", "tokens", "first", "flat", "sizes").mapInArrow(_scores(sent, weights), "piece long, ids array<long>, held array<boolean>, tokens binary, first binary, score binary")
    joined = scored.join(back, "piece", "left")
    return joined.mapInArrow(_sums(int(whole[0] or 0), int(whole[1] or 0), int(size[1] or 0)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
